"""Operator 5: exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aptaforge.llm.common import SPACE, drop_marked, join_on, lean, materialize, spread, text_batches

#: One random 32-bit number for each byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 77) for b in range(256)], dtype=np.uint32)


def boundaries(data: bytes, bits: int = 11, longest: int = 1 << 16) -> list[int]:
    """Ends of the chunks of ``data``: after each byte at which the rolling hash of the 32 bytes up to it
    has ``bits`` zero bits, and at least every ``longest`` bytes. Only local content decides."""
    n = len(data)
    if n == 0:
        return []
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if n > step:
            shifted = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += shifted
    cuts = (np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1).tolist()
    if not cuts or cuts[-1] != n:
        cuts.append(n)
    out, last = [], 0
    for c in cuts:
        while c - last > longest:
            last += longest
            out.append(last)
        out.append(c)
        last = c
    return out


def chunker(bits: int, id_bytes: int):
    @F.pandas_udf("ids array<binary>, chunks array<binary>")
    @lean()
    def chunk(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            ids, chunks = [], []
            for text in batch:
                data = text.encode("utf-8", "surrogatepass")
                start, parts = 0, []
                for end in boundaries(data, bits):
                    parts.append(data[start:end])
                    start = end
                chunks.append(parts)
                ids.append([xxhash.xxh3_128_digest(p)[:id_bytes] for p in parts])
            yield pd.DataFrame({"ids": ids, "chunks": chunks})

    return chunk


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def recipes(docs: DataFrame, bits: int = 11, id_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, text_sha256 and its recipe, the ordered list of verified chunk identifiers.

    Chunks are deduplicated by identifier and content together, before and after the shuffle, so
    each distinct chunk moves once from a task. An identifier that stands for more than one
    content is told apart by the content's rank; the recipe then names that too.
    """
    text_batches(docs.sparkSession)
    body = normalised()
    cut = docs.select("doc_id", body.alias("_body")).select(
        "doc_id", F.sha2("_body", 256).alias("text_sha256"), chunker(bits, id_bytes)("_body").alias("c")
    )
    cut = materialize(cut.select("doc_id", "text_sha256", "c.ids", "c.chunks"), "dedup-chunks")
    piece = cut.select(F.explode(F.arrays_zip("ids", "chunks")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.chunks").alias("chunk"))
    distinct = piece.groupBy("id", "chunk").agg(F.count("*").alias("n"))
    shared = materialize(distinct.groupBy("id").agg(F.count("*").alias("contents")).filter("contents > 1"), "dedup-shared-ids")
    if shared.limit(1).count() == 0:
        return cut.select("doc_id", "text_sha256", F.col("ids").alias("recipe"))
    named = join_on(distinct, shared.select("id"), ["id"])
    named = named.select("id", "chunk", F.row_number().over(Window.partitionBy("id").orderBy("chunk")).alias("rank"))
    tagged = cut.withColumn("row", F.monotonically_increasing_id())
    tagged = materialize(tagged, "dedup-tagged")
    parts = tagged.select("row", F.posexplode_outer(F.arrays_zip("ids", "chunks")).alias("pos", "x"))
    parts = parts.select("row", "pos", F.col("x.ids").alias("id"), F.col("x.chunks").alias("chunk"))
    parts = spread(parts, named, ["id", "chunk"], ["row", "pos"], "left")
    name = F.when(F.col("id").isNotNull(), F.concat("id", F.coalesce(F.col("rank").cast("string"), F.lit("0")).cast("binary")))
    lists = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", name.alias("id"))))).alias("l"))
    lists = lists.select("row", F.col("l.id").alias("recipe"))
    return join_on(tagged.select("row", "doc_id", "text_sha256"), lists, ["row"]).drop("row")


def group_copies(docs: DataFrame, bits: int = 11, id_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree after each run of white space becomes one space: their
    recipes are then the same list. The smallest doc_id of a group stays; of rows that repeat
    that doc_id and text, one stays. Null text counts as empty; a null doc_id stays only if
    its group has no other; an empty table gives no rows.
    """
    rows = materialize(recipes(docs, bits, id_bytes).withColumn("row", F.monotonically_increasing_id()), "dedup-recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))["row"]
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), first.alias("first_row"))
    out = spread(rows, groups, ["recipe"], ["doc_id", "row"])
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("first_row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the rows that group_copies keeps: one of each group of equal texts.

    A row is told by its doc_id and text together, null-safely, so ids may repeat or be null; null text counts as empty.
    Extra columns pass through whatever their names; an empty table stays empty. Texts
    move only if over 500,000 pairs of id and text go, and those of rows that repeat such a pair.
    """
    pairs = group_copies(docs).groupBy("doc_id", F.unhex("text_sha256").alias("sha")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    marks = materialize(pairs.filter("not stays or n > 1").drop("n"), "dedup-marks")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.unhex(F.sha2(normalised(), 256)).alias("sha"))
    return drop_marked(rows, marks, ["doc_id", "sha"])
