"""k-mers, position frequencies, consensus, primers and variable positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aptaforge.functions.sequences import kmers


def kmer_counts(df: DataFrame, seq: str = "s", k: int = 6, gap: int = 0) -> DataFrame:
    """(kmer, n, frequency): of k-mers of A, C, G, T only; frequency over all of them."""
    if k <= 10:
        grams = df.select(F.col(seq)).mapInArrow(gram_counter(k, gap), "kmer string, n long")
    else:
        grams = df.select(F.explode(kmers(F.col(seq), k, gap)).alias("kmer"), F.lit(1).alias("n")).filter(F.col("kmer").rlike("^[ACGT]+$"))
    counts = grams.groupBy("kmer").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select("kmer", "n", (F.col("n") / F.col("_all")).alias("frequency"))  # one row


#: Places of A, C, G, T by their codes; 4 elsewhere.
PLACE = np.full(256, 4, dtype=np.int64)
PLACE[[ord(c) for c in "ACGT"]] = range(4)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, joined, and where each begins and the last ends."""
    rows = [(s or "").encode("latin-1", "replace") for s in column.to_pylist()]
    return np.frombuffer(b"".join(rows), dtype=np.uint8), np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]


def gram_counter(k: int, gap: int):
    """Counts of the k-mers of A, C, G, T of a batch: letters as digits, and one number for each place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = (k - 1) * (gap + 1) + 1
        for batch in batches:
            data, ends = letters(batch.column(0))
            n = len(data) - span + 1
            if n <= 0:
                continue
            place = PLACE[data]
            code, good = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
            for j in range(k):
                at = place[j * (gap + 1) : j * (gap + 1) + n]
                code = code * 4 + at
                good &= at < 4
            for e in ends[1:-1]:  # places whose k-mer would reach into the next string
                good[max(0, e - span + 1) : e] = False
            values, sizes = np.unique(code[good], return_counts=True)
            digits = values[:, None] // 4 ** np.arange(k - 1, -1, -1) % 4
            names = np.frombuffer(b"ACGT", dtype="S1")[digits].view(f"S{k}").ravel().astype(str)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["kmer", "n"])

    return count


def place_counter(width: int | None):
    """(pos, base, n) of a batch: how often a letter is at a place, of the first ``width`` places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = letters(batch.column(0))
            if not len(data):
                continue
            pos = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
            key = pos * 256 + data
            values, sizes = np.unique(key if width is None else key[pos < width], return_counts=True)
            bases = [chr(v) for v in (values % 256).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(values // 256, pa.int32()), pa.array(bases, pa.string()), pa.array(sizes, pa.int64())], names=["pos", "base", "n"])

    return count


def place_counts(df: DataFrame, seq: str, width: int | None = None) -> DataFrame:
    rows = df.select(F.col(seq) if width is None else F.substring(F.col(seq), 1, width).alias(seq))
    return rows.mapInArrow(place_counter(width), "pos int, base string, n long").groupBy("pos", "base").agg(F.sum("n").alias("n"))


def kmer_frequencies(df: DataFrame, key: str, seq: str = "s", k: int = 3, gap: int = 0) -> DataFrame:
    """(key, kmer, frequency) in long form, of the k-mers that occur."""
    grams = df.select(key, kmers(F.col(seq), k, gap).alias("g")).select(key, F.size("g").alias("total"), F.explode("g").alias("kmer"))
    return grams.groupBy(key, "kmer").agg((F.count("*") / F.max("total")).alias("frequency"))


def standardise(long: DataFrame, key: str, n_rows: int, dim: str = "kmer", value: str = "frequency", least: float = 1e-10) -> DataFrame:
    """z-scores (population deviation) of a sparse long-form matrix of ``n_rows`` rows; absent cells are 0 and keep the dimension's
    ``zero_z``; dimensions of variance up to ``least`` go."""
    stats = long.groupBy(dim).agg((F.sum(value) / n_rows).alias("_m"), (F.sum(F.col(value) * F.col(value)) / n_rows).alias("_q"))
    stats = stats.withColumn("_v", F.col("_q") - F.col("_m") * F.col("_m")).filter(F.col("_v") > least)
    sd = F.sqrt("_v")
    return long.join(stats, dim).select(key, dim, ((F.col(value) - F.col("_m")) / sd).alias("z"), (-F.col("_m") / sd).alias("zero_z"))


def feature_k(df: DataFrame, seq: str = "s") -> int:
    """k by mean length: 2 below 10, 3 below 18, else 4."""
    mean = df.agg(F.avg(F.length(seq))).first()[0] or 0
    return 2 if mean < 10 else 3 if mean < 18 else 4


def position_frequencies(df: DataFrame, seq: str = "s", longest: int = 100) -> DataFrame:
    """(pos, base, n, frequency) for the positions that all sequences have, up to ``longest``; frequency over all sequences."""
    n, shortest = df.agg(F.count("*"), F.min(F.length(seq))).first()
    width = min(shortest or 0, longest)
    counts = place_counts(df, seq, width).filter(F.col("base").isin(*"ACGT"))
    return counts.withColumn("frequency", F.col("n") / F.lit(n or 1))


def consensus(pfm: DataFrame) -> DataFrame:
    """(pos, letter): the most frequent base (A, C, G, T in ties), in lower case unless over half."""
    best = pfm.groupBy("pos").agg(F.max(F.struct("frequency", F.translate("base", "ACGT", "4321").alias("t"), "base")).alias("b"))
    return best.select("pos", F.when(F.col("b.frequency") > 0.5, F.col("b.base")).otherwise(F.lower("b.base")).alias("letter"))


def primer_lengths(df: DataFrame, order: str, seq: str = "s", sample: int = 200, share: float = 0.9, least: int = 4) -> DataFrame:
    """One row (prefix_len, suffix_len): how far the first ``sample`` sequences agree with the first by ``share``; below ``least`` is 0."""
    head = df.orderBy(order).limit(sample).select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(seq).alias("s"))

    def grown(rows: DataFrame, name: str) -> DataFrame:
        letters = rows.select("i", F.posexplode(F.filter(F.split("s", ""), lambda c: c != "")).alias("pos", "base"))
        first = letters.filter("i = 1").select("pos", F.col("base").alias("want"))
        rates = first.join(letters, "pos", "left").groupBy("pos").agg(F.sum((F.col("base") == F.col("want")).cast("int")).alias("same"))
        n = rows.agg(F.count("*").alias("total"), F.max(F.when(F.col("i") == 1, F.length("s"))).alias("width"))
        bad = rates.crossJoin(F.broadcast(n)).agg(F.min(F.when(F.col("same") < F.col("total") * share, F.col("pos"))).alias("bad"), F.max("width").alias("width"))
        length = F.coalesce("bad", "width", F.lit(0))
        return bad.select(F.when(length < least, 0).otherwise(length).cast("int").alias(name))

    return grown(head, "prefix_len").crossJoin(grown(head.select("i", F.reverse("s").alias("s")), "suffix_len"))


def variable_positions(df: DataFrame, seq: str = "s", share: float = 0.8) -> DataFrame:
    """(pos, top_share) of positions whose commonest letter has less than ``share`` of all sequences."""
    n = df.count()
    top = place_counts(df, seq).groupBy("pos").agg((F.max("n") / F.lit(n or 1)).alias("top_share"))
    return top.filter(F.col("top_share") < share)
