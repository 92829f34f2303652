"""Tables in the shared folder, and ranks and running sums of groups of any size, by range partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Where it is unset, a local master (as in tests) gets a temporary folder of its own; a cluster raises an error,
    as its machines do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="aptaforge-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that survive lost executors, and keeps column pruning
    and filter pushdown for what reads the table.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps ``keys`` once, from the left."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def in_order(order: list[str]) -> list[Column]:
    """Sort columns, nulls last; a name that begins with - sorts by falling value."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Range-partition and sort by ``order``, note the partition in ``_part``, and materialize."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = in_order(order)
    return materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), name)


#: Rows that one task may order.
FEW = 100_000


def prefix_sums(
    df: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column], name: str, per_group: DataFrame | None = None, few: int = FEW, written: bool = False
) -> DataFrame:
    """Exclusive running sums within ``groups`` in ``order``, over any number of rows in a group.

    ``df`` is written first (unless ``written``), as it is read more than once. Up to ``few`` rows in all are ordered by plain windows. More
    are range-partitioned by (groups, order). Each slice (group within a partition) is
    totalled, the totals are prefix-summed (at most one row for each partition and group), and
    every row adds its position within its slice. No task holds more than a slice. ``per_group``,
    unique on ``groups``, joins to the slices, so that its columns reach the rows without a
    join on a hot group.
    """
    df = df if written else materialize(df, name)
    if few and df.limit(few + 1).count() <= few:
        whole = Window.partitionBy(*groups).orderBy(*in_order(order)).rowsBetween(Window.unboundedPreceding, -1)
        out = df.select("*", *[F.coalesce(F.sum(v).over(whole), F.lit(0)).alias(k) for k, v in sums.items()])
        return out if per_group is None else join_on(out, per_group, groups)
    cut = ranged(df, [*groups, *order], f"{name}-ranged")
    slices = cut.groupBy(*groups, "_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    if per_group is not None:
        slices = join_on(slices, per_group, groups)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *[c for c in slices.columns if not c.startswith("_t_")],
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums],
    )
    within = Window.partitionBy(*groups, "_part").orderBy(*in_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_l_{k}") for k, v in sums.items()])
    out = join_on(local, slices, [*groups, "_part"])
    out = out.withColumns({k: F.col(f"_l_{k}") + F.col(f"_b_{k}") for k in sums})
    return out.drop("_part", *[f"_l_{k}" for k in sums], *[f"_b_{k}" for k in sums])


def positions(
    df: DataFrame, groups: list[str], order: list[str], into: str = "rank", name: str = "positions", per_group: DataFrame | None = None, few: int = FEW, written: bool = False
) -> DataFrame:
    """``df`` plus ``into``, the place from 1 of each row within ``groups`` in ``order``: a row number without a window over a whole group."""
    out = prefix_sums(df, groups, order, {into: F.lit(1)}, name, per_group, few, written)
    return out.withColumn(into, (F.col(into) + 1).cast("long"))
