"""Readers of sequencing reads: FASTA, FASTQ, TSV and plain lines, gzip by suffix or magic bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aptaforge.functions.sequences import header_count, is_iupac, leading_int
from aptaforge.operators.ranges import positions


def detect_format(lines: DataFrame) -> str:
    """"tsv", "fasta", "fastq" or "lines", from a DataFrame of ``value``: one aggregate over the lines."""
    v = F.col("value")
    row = lines.filter(F.trim(v) != "").agg(
        F.max(v.startswith(">")).alias("header"), F.max(~v.startswith(">") & v.contains("\t")).alias("tab"), F.max(v.rlike("^@")).alias("at"), F.max(v.rlike(r"^\+")).alias("plus")
    ).first()
    if row["header"] and not row["at"]:
        return "fasta"
    if row["tab"]:
        return "tsv"
    if row["at"] and row["plus"]:
        return "fastq"
    return "fasta" if row["header"] else "lines"


def collapse(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of counts of each valid sequence (of each ``by``), in upper case."""
    rows = reads.filter(is_iupac(F.col("sequence"))).select(*(by or []), F.upper(F.col("sequence")).alias("sequence"), "read_count")
    return rows.groupBy(*(by or []), "sequence").agg(F.sum("read_count").alias("read_count"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence, read_count) of each entry with a sequence; entries split at line-initial '>'."""
    entry = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.split(entry, "\n").alias("l"))
    lines = F.transform(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda x: F.trim(x))
    out = rows.select(F.trim(F.col("l")[0]).alias("header"), F.upper(F.array_join(lines, "")).alias("sequence"))
    return out.filter("sequence != ''").withColumn("read_count", header_count(F.col("header")))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence, read_count 1) of records of four lines, whose sequence is not empty.

    Files split where a line begins with @, which is a record or a quality line: sequences and third lines never begin so. A
    part of three lines or more whose third begins with + is a record, with or without its quality line; a part of
    one line is a quality line. So files of any size are read by many tasks, and no part holds more than a record.
    """
    part = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^@", "")
    rows = spark.read.option("lineSep", "\n@").text(path).select(F.split(part, "\n").alias("l")).filter((F.size("l") >= 3) & F.get("l", F.lit(2)).startswith("+"))
    out = rows.select(F.col("l")[0].alias("header"), F.upper(F.trim(F.col("l")[1])).alias("sequence"), F.lit(1).cast("long").alias("read_count"))
    return out.filter("sequence != ''")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).filter(F.size(parts) >= 2).select(F.upper(F.trim(parts[0])).alias("sequence"), leading_int(parts[1]).alias("read_count"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("sequence"), F.lit(1).cast("long").alias("read_count")).filter("sequence != ''")


READERS = {"fasta": read_fasta, "fastq": read_fastq, "tsv": read_tsv, "lines": read_lines}


def read_reads(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Counted unique sequences of the files at ``path``; raises ValueError if there are none."""
    form = form or detect_format(spark.read.text(path))
    out = collapse(READERS[form](spark, path).select("sequence", "read_count"))
    if not out.limit(1).count():
        raise ValueError(f"no valid sequence in {path}")
    return out


#: Bytes of one file that is looked at whole.
UPLOAD = 200 << 20


def inflate(spark: SparkSession, path: str, out_dir: str, most: int = UPLOAD) -> str:
    """Files at ``path`` as text at ``out_dir``, gunzipped where the first bytes say gzip whatever the name. ValueError if one has over ``most`` bytes;
    larger ones are read where they lie, by their suffix."""
    files = spark.read.format("binaryFile").load(path)
    if files.filter(F.col("length") > most).limit(1).count():
        raise ValueError(f"a file of over {most} bytes in {path}")

    @F.pandas_udf("string")
    def text(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in contents:
            yield pd.Series([(zlib.decompress(bytes(b), 47) if bytes(b[:2]) == b"\x1f\x8b" else bytes(b)).decode("utf-8", "replace") for b in batch])

    files.select(text("content").alias("value")).write.mode("overwrite").text(out_dir)
    return out_dir


def percent_top(reads: DataFrame, keep: int = 10_000, by: list[str] | None = None) -> DataFrame:
    """Percent of all reads (of each ``by``), then the ``keep`` most read sequences of each. Ranks come from ranges, so no task holds a group."""
    by = by or []
    if not by:
        total = reads.agg(F.sum("read_count")).first()[0] or 1
        return reads.withColumn("percent_read", F.col("read_count") / F.lit(total) * 100).orderBy(F.col("read_count").desc(), "sequence").limit(keep)
    totals = reads.groupBy(*by).agg(F.sum("read_count").alias("_total"))
    out = positions(reads, by, ["-read_count", "sequence"], "_rank", "percent-top", totals).filter(F.col("_rank") <= keep)
    return out.withColumn("percent_read", F.col("read_count") / F.col("_total") * 100).drop("_rank", "_total")
