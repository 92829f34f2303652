"""G-quadruplex scores as column expressions over upper-case DNA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aptaforge.functions.sequences import kmers, let

# Four tracts with loops of 1 to 7; weights of the composite score; intercept and weights of the logistic score.
MOTIF = "(G{2,}).{1,7}(G{2,}).{1,7}(G{2,}).{1,7}(G{2,})"


COMPOSITE = {"cgcc": 0.2, "hunter": 0.3, "nn": 0.3, "motif": 0.2}
LOGISTIC = {"intercept": -2.5, "g_share": 6.0, "motifs": 3.0, "longest": 2.5, "tracts": 2.0, "loops": 1.5}


def rounded(x: Column, places: int) -> Column:
    """``x`` to ``places``, halves away from zero, of its product with the power of ten, as DuckDB takes it: 0.07125, a little less in binary, gives 0.0712."""
    return F.round(x * 10.0**places, 0) / 10.0**places


def runs(seq: Column, base: str) -> Column:
    """Lengths of maximal runs of ``base``; long, as scores grow with their cube."""
    return F.transform(F.regexp_extract_all(seq, F.lit(f"{base}+"), F.lit(0)), lambda r: F.length(r).cast("long"))


def total(values: Column, each=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + each(x))


def cgcc(seq: Column) -> Column:
    """Ratio of run scores of G and C: a run of length L holds L(L+1)(L+2)/6 weighted sub-runs, of 10 each. No C counts as 1."""
    score = lambda b: total(runs(seq, b), lambda n: F.call_function("div", 10 * n * (n + 1) * (n + 2), F.lit(6)))
    c = score("C")
    return score("G") / F.when(c == 0, 1).otherwise(c)


def hunter(seq: Column) -> Column:
    """Mean over letters of min(run, 4), negative for C."""
    score = lambda b: total(runs(seq, b), lambda n: F.least(n, F.lit(4).cast("long")) * n)
    return F.when(F.length(seq) > 0, (score("G") - score("C")) / F.length(seq)).otherwise(F.lit(0.0))


def trimer_features(seq: Column) -> Column:
    """Shares of the 64 trimers of A, U, C, G, in that order, of an RNA sequence."""
    letters = "AUCG"
    names = [a + b + c for a in letters for b in letters for c in letters]
    grams = kmers(seq, 3)
    return let(grams, lambda all_: F.transform(F.array(*map(F.lit, names)), lambda g: F.size(F.filter(all_, lambda x: x == g)) / F.greatest(F.size(all_), F.lit(1))))


def motifs(seq: Column) -> Column:
    """One struct (start, end, motif, score) for each start at which four tracts with loops of 1 to 7 match, best first."""
    return let(seq, _motifs)


def _motifs(seq: Column) -> Column:
    starts = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(starts, lambda i: F.substring(seq, i, F.lit(2)) == "GG")
    found = F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.regexp_extract(F.substring(seq, i, F.length(seq)), f"^{MOTIF}", 0).alias("motif")))
    found = F.filter(found, lambda m: m["motif"] != "")

    def tract(m: Column, g: int) -> Column:
        return F.length(F.regexp_extract(m["motif"], f"^{MOTIF}$", g))

    def score(m: Column) -> Column:
        tracts = [tract(m, g) for g in range(1, 5)]
        loops = F.filter(F.split(m["motif"], "G+"), lambda x: x != "")
        mean_loop = F.when(F.size(loops) > 0, total(loops, lambda x: F.length(x)) / F.size(loops)).otherwise(F.lit(0.0))
        return rounded((2 * F.least(*tracts) + sum(tracts[1:], tracts[0])) / (1 + 0.5 * mean_loop), 2)

    out = F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["motif"])).alias("end"), m["motif"].alias("motif"), score(m).alias("score")))
    return F.array_sort(out, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["start"] - b["start"]))


def rich_regions(seq: Column) -> Column:
    """Maximal runs of two or more G."""
    return F.regexp_extract_all(seq, F.lit("G{2,}"), F.lit(0))


def composite(cgcc_: Column, hunter_: Column, nn: Column, top_motif: Column) -> Column:
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    w = COMPOSITE
    parts = w["cgcc"] * clip(cgcc_ / 10) + w["hunter"] * F.least(F.abs(hunter_) / 2, F.lit(1.0)) + w["nn"] * clip(nn) + w["motif"] * F.least(F.coalesce(top_motif, F.lit(0.0)) / 10, F.lit(1.0))
    return rounded(F.least(2 * parts, F.lit(2.0)), 3)


def simple_cgcc(seq: Column) -> Column:
    n, g, c = F.length(seq), F.length(seq) - F.length(F.translate(seq, "G", "")), F.length(seq) - F.length(F.translate(seq, "C", ""))
    return F.when(n > 0, (g - c) * (g / n) * (100 / n)).otherwise(F.lit(0.0))


def simple_nn(seq: Column, found: Column) -> Column:
    """Logistic score of G content, motifs, longest tract, tract density and loop regularity."""
    n, tracts, w = F.length(seq), runs(seq, "G"), LOGISTIC
    g = F.length(seq) - F.length(F.translate(seq, "G", ""))
    loops = F.transform(F.filter(F.split(F.coalesce(F.get(found, F.lit(0))["motif"], F.lit("")), "G+"), lambda x: x != ""), lambda x: F.length(x))

    def regularity(lens: Column) -> Column:
        mean = total(lens) / F.size(lens)
        variance = let(mean, lambda m: F.aggregate(lens, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))) / F.size(lens)
        return F.when(F.size(lens) >= 3, F.when(mean <= 3, 1.2).otherwise(1.0) / (1 + variance)).otherwise(F.lit(0.0))

    regular = let(loops, regularity)
    z = (
        F.lit(w["intercept"]) + g / n * w["g_share"] + F.least(F.size(found) / 3, F.lit(1.0)) * w["motifs"]
        + F.least(F.coalesce(F.array_max(tracts), F.lit(0)) / 5, F.lit(1.0)) * w["longest"]
        + F.least(F.size(F.filter(tracts, lambda x: x >= 2)) / 4, F.lit(1.0)) * w["tracts"] + regular * w["loops"]
    )
    return F.when(n > 0, rounded(1 / (1 + F.exp(-z)), 3)).otherwise(F.lit(0.0))


def window_hunter(df: DataFrame, key: str, seq: str, size: int = 25) -> DataFrame:
    """(key, window_score): the largest absolute mean of run scores over windows of ``size`` letters.

    Prefix sums of the letters' scores are built within the row, so a window costs one subtraction and
    nothing is shuffled.
    """
    s = F.col(seq)
    pieces = F.regexp_extract_all(s, F.lit("G+|C+|[^GC]+"), F.lit(0))
    signed = F.transform(
        pieces,
        lambda p: F.array_repeat(
            F.when(F.substring(p, 1, 1) == "G", F.least(F.length(p), F.lit(4))).when(F.substring(p, 1, 1) == "C", -F.least(F.length(p), F.lit(4))).otherwise(0), F.length(p)
        ),
    )
    out = df.select(key, F.flatten(signed).alias("_s"))
    out = out.select(key, "_s", F.least(F.size("_s"), F.lit(size)).alias("_w"))
    sums = F.aggregate(F.slice(F.col("_s"), F.lit(1), F.col("_w")), F.lit(0), lambda a, x: a + x)
    step = F.zip_with(F.slice(F.col("_s"), F.col("_w") + 1, F.size("_s")), F.slice(F.col("_s"), F.lit(1), F.size("_s") - F.col("_w")), lambda new, old: new - old)
    best = F.aggregate(
        step, F.struct(sums.alias("now"), F.abs(sums).alias("best")),
        lambda a, d: F.struct((a["now"] + d).alias("now"), F.greatest(a["best"], F.abs(a["now"] + d)).alias("best")), lambda a: a["best"],
    )
    return out.select(key, F.when(F.size("_s") > 0, best / F.col("_w")).otherwise(F.lit(0.0)).alias("window_score"))


def fallback(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, cgcc, g4hunter, g4nn, g4_score, num_g4_motifs), to three places: the scores of upper-case DNA that need no service. The composite takes
    the window score as it is, up to 2, and the logistic score."""
    out = df.select(key, F.col(seq).alias("_s"), motifs(F.col(seq)).alias("_m"))
    out = out.select(key, "_m", simple_cgcc(F.col("_s")).alias("cgcc"), simple_nn(F.col("_s"), F.col("_m")).alias("g4nn"))
    out = out.join(window_hunter(df, key, seq), key).withColumnRenamed("window_score", "g4hunter")
    score = composite(F.col("cgcc"), F.col("g4hunter"), F.col("g4nn"), F.get("_m", F.lit(0))["score"])
    return out.select(key, rounded(F.col("cgcc"), 3).alias("cgcc"), rounded(F.col("g4hunter"), 3).alias("g4hunter"), "g4nn", score.alias("g4_score"), F.size("_m").alias("num_g4_motifs"))


def passes(cgcc_: Column, hunter_: Column, nn: Column) -> Column:
    return (cgcc_ > 4.5).cast("int") + (hunter_ > 0.9).cast("int") + (nn > 0.5).cast("int")


def risk_by_score(score: Column) -> Column:
    return F.when(score >= 1, "High").when(score >= 0.5, "Medium").otherwise("Low")


def risk_by_passes(n: Column) -> Column:
    return F.when(n >= 2, "High").when(n == 1, "Medium").otherwise("Low")
