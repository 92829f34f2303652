"""Shared plumbing: skew-proof joins, and the tables and distributed prefix sums of operators.ranges."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aptaforge.operators.ranges import join_on, materialize, positions, prefix_sums, ranged

__all__ = [
    "SPACE", "WORD", "drop_marked", "join_on", "lean", "let", "materialize", "positions", "prefix_sums", "ranged", "shuffle_partitions", "spread", "table", "text_batches",
    "worker_cache",
]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send Python workers at most ``rows`` texts at once: they may be long, and a batch is held several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def worker_cache() -> dict:
    """What a Python worker keeps from task to task, such as compiled tokenizers."""
    return vars(sys).setdefault("_aptaforge_worker_cache", {})


def release() -> None:
    """Give memory that Arrow and the allocator keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(kind: str | None = None) -> Callable:
    """Wraps a function over an iterator of batches, so that a Python worker holds little between batches and once idle.

    Workers live on after their task and count against their executor's memory. What they keep for other
    operators goes when a task begins: only ``kind``, the first part of a key of ``worker_cache``, stays.
    """

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(batches: Iterator) -> Iterator:
            kept = worker_cache()
            for key in [k for k in kept if k[0] != kind]:
                del kept[key]

            def one_by_one():
                for batch in batches:
                    yield batch
                    del batch
                    release()

            yield from f(one_by_one())
            release()

        return run

    return wrap


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` uses it many times and it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame, per_key: DataFrame, keys: list[str], salt_by: list[str], how: str = "inner") -> DataFrame:
    """Join ``per_key`` (unique on ``keys``) to ``df`` without gathering a hot key in one task.

    Each row gets a salt from ``salt_by``; ``per_key`` meets only the distinct (key, salt)
    slots, at most one for each shuffle partition and key, and the rows then join on key and salt.
    """
    n = shuffle_partitions(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by, F.lit("salt")), F.lit(n)).cast("int"))
    slots = salted.select(*keys, "_salt").distinct()
    return join_on(salted, join_on(slots, per_key, keys, how), [*keys, "_salt"], how).drop("_salt")


def drop_marked(rows: DataFrame, marks: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """The structs ``doc`` of ``rows`` (doc, and ``keys``) by their ``marks`` (unique on ``keys``, which compare null-safely, and a flag ``stays``).

    Rows without a mark stay; those whose mark does not stay go; of the rows that share a mark that
    stays, the first as JSON does. Marks are broadcast up to ``most``, else joined by sort-merge.
    """
    small = marks.limit(most + 1).count() <= most
    joined = join_on(rows, F.broadcast(marks) if small else marks.hint("merge"), keys, "left")
    out = joined.filter("stays is null").select("doc")
    if marks.filter("stays").limit(1).count():
        out = out.unionAll(joined.filter("stays").groupBy(*keys).agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc"))
    return out.select("doc.*")
