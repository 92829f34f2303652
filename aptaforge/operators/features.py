"""Feature vectors of sequences: primers off, k by length, k-mers with gapped k-mers and scores, standardised."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aptaforge.functions.sequences import trim
from aptaforge.operators import motifs
from aptaforge.operators.ranges import materialize

MODES = ("kmer", "hybrid", "structural")


def primers(df: DataFrame, order: str, seq: str, forward: str | None = None, reverse: str | None = None) -> tuple[int, int]:
    """Lengths to cut at both ends: those of the primers given, else as detected."""
    if forward or reverse:
        return len(forward or ""), len(reverse or "")
    row = motifs.primer_lengths(df, order, seq).first()
    return (row["prefix_len"], row["suffix_len"]) if row else (0, 0)


def dense(df: DataFrame, key: str, seq: str, k: int, gap: int = 0) -> DataFrame:
    """(key, v): shares of all 4^k k-mers of A, C, G, U, in order; zeros for a sequence with none."""
    rows = df.select(key, F.regexp_replace(F.translate(F.upper(F.col(seq)), "T", "U"), "[^ACGU]", "").alias("_s"))
    shares = motifs.kmer_frequencies(rows, key, "_s", k, gap).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "frequency"))).alias("_m"))
    names = F.array(*[F.lit("".join(g)) for g in product("ACGU", repeat=k)])
    return rows.select(key).join(shares, key, "left").select(key, F.transform(names, lambda g: F.coalesce(F.element_at("_m", g), F.lit(0.0))).alias("v"))


def scaled(vecs: DataFrame, key: str, least: float = 1e-10) -> DataFrame:
    """``v`` with mean 0 and population deviation 1 in each dimension. Dimensions of no spread go, unless none has any.

    Means and deviations, a few hundred numbers, become literals of the second pass.
    """
    long = vecs.select(F.posexplode("v").alias("pos", "x")).groupBy("pos")
    stats = long.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").collect()
    kept = [r for r in stats if r["s"] ** 2 > least]
    if not kept:
        return vecs.select(key, F.transform("v", lambda x: x * 0.0).alias("v"))
    table = F.array(*[F.struct(F.lit(r["pos"] + 1).alias("at"), F.lit(r["m"]).alias("m"), F.lit(r["s"]).alias("s")) for r in kept])
    return vecs.select(key, F.transform(table, lambda d: (F.element_at(F.col("v"), d["at"]) - d["m"]) / d["s"]).alias("v"))


def prepare(
    df: DataFrame, key: str = "id", seq: str = "sequence", forward: str | None = None, reverse: str | None = None,
    mode: str = "kmer", scores: list[str] | None = None, standardise: bool = True,
) -> DataFrame:
    """(key, v) of sequences. ``hybrid`` adds gapped 3-mers at half weight and standardised ``scores`` columns at 0.3;
    ``structural`` takes the scores alone. Primers are sought in the order of ``key``, which must be unique."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    columns = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in scores or []])
    if mode == "structural" and scores:
        out = df.select(key, columns.alias("v"))
        return scaled(materialize(out, "features"), key) if standardise else out
    a, b = primers(df, key, seq, forward, reverse)
    cut = df.select(key, trim(F.col(seq), F.lit(a), F.lit(b)).alias("_cut"))
    k = motifs.feature_k(cut, "_cut")
    out = dense(cut, key, "_cut", k)
    if mode == "hybrid":
        gapped = dense(cut, key, "_cut", min(k, 3), gap=1).select(key, F.transform("v", lambda x: x * 0.5).alias("_g"))
        out = out.join(gapped, key).select(key, F.concat("v", "_g").alias("v"))
        if scores:
            extra = scaled(df.select(key, columns.alias("v")), key, least=0.0).select(key, F.transform("v", lambda x: x * 0.3).alias("_x"))
            out = out.join(extra, key).select(key, F.concat("v", "_x").alias("v"))
    return scaled(materialize(out, "features"), key) if standardise else out
