"""Enrichment across selection rounds, and read statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aptaforge.operators.ranges import join_on, materialize, positions, prefix_sums


def with_percent(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``reads`` plus percent_read, the share of all reads of each ``by``. Totals join back (one row a group, which adaptive execution
    broadcasts if they are small, or splits the hot groups), so that no round is in one task."""
    by = by or ["round_number"]
    totals = reads.groupBy(*by).agg(F.sum("read_count").alias("_total"))
    return join_on(reads, totals, by).withColumn("percent_read", F.col("read_count") / F.col("_total") * 100).drop("_total")


def ranked(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``reads`` plus rank within each ``by``, most read first, ties by sequence."""
    return positions(reads, by or ["round_number"], ["-read_count", "sequence"], "rank", "round-ranks")


def round_numbers(rounds: DataFrame) -> list[int]:
    return [r[0] for r in rounds.select("round_number").distinct().orderBy("round_number").collect()]


def enrichment(rounds: DataFrame, numbers: list[int] | None = None, min_reads: int = 1, min_percent: float = 0.0, top: int | None = 200) -> DataFrame:
    """Per sequence: fold between the last and the first round, is_new (only the last has it), and totals.

    ``rounds``: round_number, sequence, read_count, percent_read. One aggregation with a
    conditional per round, so its shuffle carries one partial row for each sequence and task. A sequence in the last round passes only with
    ``min_reads`` and ``min_percent`` there; one that is absent passes. Ordered by fold (new first, none as 0), then percent, then sequence.
    """
    numbers = numbers or round_numbers(rounds)
    first, last = numbers[0], numbers[-1]
    at = lambda n, c: F.max(F.when(F.col("round_number") == n, F.col(c)))
    out = rounds.groupBy("sequence").agg(
        at(first, "percent_read").alias("_first"), at(last, "percent_read").alias("_last"), at(last, "read_count").alias("_reads"),
        F.max("percent_read").alias("max_percent_read"), F.sum("read_count").alias("total_reads"),
        F.sum((F.col("read_count") > 0).cast("int")).alias("present_in_rounds"),
        *[F.coalesce(at(n, "read_count"), F.lit(0)).alias(f"r{n}") for n in numbers],
    )
    out = out.filter(F.col("_last").isNull() | ((F.col("_reads") >= min_reads) & (F.col("_last") >= min_percent)))
    a, b = F.coalesce("_first", F.lit(0.0)), F.coalesce("_last", F.lit(0.0))
    out = out.withColumn("fold", F.when(a > 0, b / a)).withColumn("is_new", (a == 0) & (b > 0))
    out = out.drop("_first", "_last", "_reads")
    key = F.when(F.col("is_new"), 1e15).otherwise(F.coalesce("fold", F.lit(0.0)))
    return out.orderBy(key.desc(), F.col("max_percent_read").desc(), "sequence").limit(top) if top else out


def cross_round_totals(rounds: DataFrame, min_reads: int = 2) -> DataFrame:
    out = rounds.groupBy("sequence").agg(F.sum("read_count").alias("total_reads"), F.max("percent_read").alias("max_percent_read"), F.count("*").alias("present_in_rounds"))
    return out.filter(F.col("total_reads") >= min_reads)


def merge_rounds(rounds: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """(sequence, total_reads, round_reads): counts per round, 0 where absent."""
    numbers = numbers or round_numbers(rounds)
    each = [F.coalesce(F.sum(F.when(F.col("round_number") == n, F.col("read_count"))), F.lit(0)) for n in numbers]
    return rounds.groupBy("sequence").agg(F.sum("read_count").alias("total_reads"), F.array(*each).alias("round_reads"))


def fold_direction(merged: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Mean of last / first reads (zeros as 1) of each cluster, and its direction."""
    fold = F.greatest(F.element_at("round_reads", -1), F.lit(1)) / F.greatest(F.element_at("round_reads", 1), F.lit(1))
    out = merged.groupBy(cluster).agg(F.avg(fold).alias("mean_fold"))
    return out.withColumn("direction", F.when(F.col("mean_fold") > 2, "up").when(F.col("mean_fold") < 0.5, "down").otherwise("stable"))


def cluster_stats(members: DataFrame) -> DataFrame:
    """size, avg_fold and max_fold of finite folds, avg_percent; ranked by size, then fold, as cluster_rank."""
    finite = F.when(~F.col("is_new"), F.col("fold"))
    out = members.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.round(F.coalesce(F.avg(finite), F.lit(0.0)), 2).alias("avg_fold"),
        F.round(F.coalesce(F.max(finite), F.lit(0.0)), 2).alias("max_fold"), F.max("is_new").alias("has_new"), F.round(F.avg("max_percent_read"), 4).alias("avg_percent"),
    )
    out = positions(out, [], ["-size", "-avg_fold", "cluster_id"], "cluster_rank", "cluster-ranks")
    return out.withColumn("max_is_new", F.col("has_new") & (F.col("max_fold") == 0)).drop("has_new")


def abundance_z(members: DataFrame, cluster: str = "cluster_id", reads: str = "read_count") -> DataFrame:
    """z of each cluster's reads against the spread of all reads; negative-binomial r. p comes from functions.numerics.normal_p."""
    mu, var = members.agg(F.avg(reads), F.var_pop(reads)).first()
    mu, var = mu or 0.0, var or 0.0
    r = mu * mu / (var - mu) if var > mu > 0 else mu
    out = members.groupBy(cluster).agg(F.count("*").alias("size"), F.sum(reads).alias("reads"))
    sd = F.sqrt(F.col("size") * F.lit(var))
    return out.select(cluster, "size", "reads", F.round(F.when(sd > 0, (F.col("reads") - F.col("size") * F.lit(mu)) / sd).otherwise(0.0), 3).alias("z"), F.lit(r).alias("nb_r"))


def weights(df: DataFrame, reads: str = "read_count", scheme: str = "linear") -> DataFrame:
    """``df`` plus weight: reads (at least 1) under ``scheme``, with mean 1."""
    x = F.greatest(F.col(reads), F.lit(1))
    x = {"linear": x.cast("double"), "sqrt": F.sqrt(x), "log1p": F.log1p(x)}[scheme]
    mean = df.agg(F.avg(x)).first()[0] or 1.0
    return df.withColumn("weight", x / F.lit(mean))


def abundance_split(df: DataFrame, threshold: float, reads: str = "read_count") -> DataFrame:
    """``df`` plus is_high: reads reach ``threshold``, or the percentile that leaves that fraction if it is below 1. Under 3 high rows, all are."""
    if 0 < threshold < 1:
        threshold = df.agg(F.percentile(reads, F.lit(1 - threshold))).first()[0] or 0
    high = F.col(reads) >= threshold
    few = (df.agg(F.count_if(high)).first()[0] or 0) < 3
    return df.withColumn("is_high", F.lit(True) if few else high)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """min, q1, median, q3, max, iqr; quartiles are the values at floor(n / 4) and floor(3 n / 4), counted from 0.

    Equal values become one row with their number before anything is ordered, and running numbers over ranges of values tell which value is at a place: no
    task holds a group, and no list of its values is built.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(group), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counts = materialize(counts, "box-values")
    totals = counts.groupBy(group).agg(F.sum("_c").alias("_n"))
    placed = prefix_sums(counts, [group], ["_v"], {"_i": F.col("_c")}, "box", totals, written=True)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("_i") <= k) & (k < F.col("_i") + F.col("_c")), F.col("_v")))

    n = F.col("_n")
    out = placed.groupBy(group).agg(
        F.min("_v").alias("min"), at(F.floor(n * 0.25)).alias("q1"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        at(F.floor(n * 0.75)).alias("q3"), F.max("_v").alias("max"),
    )
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def dedup_points(points: DataFrame, sample: int = 5) -> DataFrame:
    """Points equal to 6 places within a cluster become one, with their number and the first ``sample`` sequences.

    Equal sequences are counted first; of each point, a task sends on no more than ``sample`` of them.
    """
    place = ["x", "y", "cluster_id"]
    keyed = points.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster_id", "sequence")
    counted = keyed.groupBy(*place, "sequence").agg(F.count("*").alias("_c"))
    sizes = counted.groupBy(*place).agg(F.sum("_c").alias("n"))
    firsts = counted.withColumn("_i", F.row_number().over(Window.partitionBy(*place).orderBy("sequence"))).filter(F.col("_i") <= sample)
    lists = firsts.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("sequence", "_c"))).alias("_l"))
    repeated = F.flatten(F.transform("_l", lambda s: F.array_repeat(s["sequence"], F.least(s["_c"], F.lit(sample)).cast("int"))))
    return join_on(sizes, lists, place).select(*place, "n", F.slice(repeated, 1, sample).alias("sample"))


def counters(rounds: DataFrame, enriched: DataFrame, screened: DataFrame | None = None, folded: DataFrame | None = None, tested: DataFrame | None = None) -> DataFrame:
    """One row of totals: rounds, total_reads, unique_rows (of all rounds), enriched (finite folds of 2 and more), n_new, and where given high, medium and low
    risk of ``screened`` (g4_score), gquads of ``folded`` (has_gquad) and significant clusters of ``tested`` (significant)."""
    parts = [
        rounds.agg(F.countDistinct("round_number").alias("rounds"), F.sum("read_count").alias("total_reads"), F.count("*").alias("unique_rows")),
        enriched.agg(F.count_if(F.coalesce(F.col("fold") >= 2, F.lit(False)) & ~F.col("is_new")).alias("enriched"), F.count_if("is_new").alias("n_new")),
    ]
    if screened is not None:
        score = F.col("g4_score")
        parts.append(screened.agg(F.count_if(score >= 1).alias("high"), F.count_if((score >= 0.5) & (score < 1)).alias("medium"), F.count_if(score < 0.5).alias("low")))
    if folded is not None:
        parts.append(folded.agg(F.count_if("has_gquad").alias("gquads")))
    if tested is not None:
        parts.append(tested.agg(F.count_if("significant").alias("significant")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def node_radius(count: Column, most: Column) -> Column:
    return 3 + 21 * F.sqrt(count / most)


def bubble_x(fold: Column, is_new: Column) -> Column:
    return F.log10(F.when(is_new | (fold > 1e10), 100.0).when(F.coalesce(fold, F.lit(0.0)) <= 0, 0.1).otherwise(fold) + 1)


def heat(cgcc: Column, hunter: Column, nn: Column, mfe: Column) -> list[Column]:
    one = F.lit(1.0)
    return [F.least(cgcc / 20, one), F.least(F.abs(hunter) / 2, one), F.least(nn, one), F.least(-mfe / 25, one)]


def sort_table(df: DataFrame, column: str, falling: bool = True, infinite: str | None = None, ties: str = "sequence") -> DataFrame:
    """``df`` in the order of one column: none as below all numbers, and where the flag ``infinite`` is set as 1e15."""
    key = F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))
    if infinite:
        key = F.when(F.col(infinite), 1e15).otherwise(key)
    return df.orderBy(key.desc() if falling else key.asc(), ties)


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)
