"""Operator 7: contiguous shards of near-equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aptaforge.llm.common import join_on, materialize, prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Cut documents, in order of doc_id, into ``shards`` contiguous shards of near-equal bytes.

    Per-partition byte and row totals give every row its global start; a document belongs to
    the shard in which its middle byte lies, so that a shard is off its target by less than
    half a document at either end. Only ids, sizes and checksums are shuffled.

    Returns doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, shard, slot (position
    in the shard from 0). Null text counts no bytes, null doc_ids come last, ties and repeated
    rows are ordered by checksum and size, and an empty table gives no rows. A shard that
    one document outgrows may leave its neighbours empty.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = materialize(
        docs.select("doc_id", (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(body).alias("text_crc32")), "shard-sized"
    )
    total = sized.agg(F.sum("size")).first()[0] or 1
    rows = prefix_sums(sized, [], ["doc_id", "text_crc32", "size"], {"_start": F.col("size"), "_row": F.lit(1)}, "shard", few=0, written=True)
    # twice the middle byte, times shards, over twice the total
    shard = F.expr(f"least(cast((2 * _start + size) * cast({shards} as decimal(20,0)) div cast({2 * total} as decimal(20,0)) as bigint), {shards - 1})")
    rows = rows.withColumn("shard", shard.cast("int"))
    # At most ``shards`` rows.
    first = rows.groupBy("shard").agg(F.min("_row").alias("_first"))
    out = join_on(rows, F.broadcast(first), ["shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
