"""Column expressions on nucleotide sequences and read headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IUPAC = r"(?i)^[ACGTURYKMSWBDHVN]+\z"
# Count patterns of read headers, tried in this order.
HEADER_COUNTS = [r"-(\d+)$", r"(?i)count[=:](\d+)", r"(?i)[x_](\d+)$", r"(?i)reads?[=:](\d+)", r"(?i)size[=:](\d+)", r"\s(\d+)$"]


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable: lambdas evaluate outer expressions anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_iupac(seq: Column) -> Column:
    return F.coalesce(seq.rlike(IUPAC), F.lit(False))


def header_count(header: Column) -> Column:
    """Read count in a FASTA header; 1 if none."""
    found = [F.nullif(F.regexp_extract(header, p, 1), F.lit("")) for p in HEADER_COUNTS]
    return F.coalesce(*found, F.lit("1")).cast("long")


def leading_int(text: Column) -> Column:
    """A field's leading integer; 1 if there is none or it is 0."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0)), F.lit(1))


def dna(seq: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "")


def rna(seq: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(seq), "T", "U"), "[^ACGU]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATCG", "TAGC"))


def kmers(seq: Column, k: int, gap: int = 0) -> Column:
    """Overlapping k-mers; with ``gap`` letters skipped between the letters of each.

    A lookahead steps through the text once; a substring at each place would count its letters from the start.
    """
    span = (k - 1) * (gap + 1) + 1
    grams = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{span}}}))"), F.lit(1))
    if gap:
        grams = F.transform(grams, lambda g: F.concat(*[F.substring(g, 1 + j * (gap + 1), 1) for j in range(k)]))
    return grams


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer; 0 if the lengths differ by over 30 %, 1 if both are empty."""
    la, lb = F.length(a), F.length(b)
    longer = F.greatest(la, lb)
    return (
        F.when((la == 0) & (lb == 0), 1.0)
        .when((la == 0) | (lb == 0), 0.0)
        .when(F.abs(la - lb) / longer > 0.3, 0.0)
        .otherwise(1 - F.levenshtein(a, b) / longer)
    )


def position_similarity(a: Column, b: Column, positions: list[int]) -> Column:
    """Share of equal letters at 0-based ``positions`` of equally long sequences, else the edit similarity."""
    if not positions:
        return edit_similarity(a, b)
    same = F.aggregate(
        F.array(*[F.lit(p + 1) for p in positions]), F.lit(0), lambda n, p: n + (F.substring(a, p, F.lit(1)) == F.substring(b, p, F.lit(1))).cast("int")
    )
    return F.when(F.length(a) == F.length(b), same / len(positions)).otherwise(edit_similarity(a, b))


def trim(seq: Column, prefix: Column, suffix: Column) -> Column:
    return F.substring(seq, prefix + 1, F.greatest(F.length(seq) - prefix - suffix, F.lit(0)))


def shorten(seq: Column, n: int) -> Column:
    return F.when(F.length(seq) > n, F.concat(F.substring(seq, 1, n), F.lit("..."))).otherwise(seq)


def fold_label(fold: Column, is_new: Column) -> Column:
    return F.when(is_new, "New").when(fold.isNull(), "N/A").otherwise(F.concat(F.format_number(fold, 2), F.lit("x")))


def p_label(p: Column, floor: float = 0.001) -> Column:
    return F.when(p < floor, F.lit(f"< {floor}")).otherwise(F.format_string("%.3f", p))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
