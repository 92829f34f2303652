"""A store of analyses and rounds: Parquet partitioned by analysis and round."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aptaforge.operators.ranges import positions
from aptaforge.sources.reads import percent_top

ANALYSES = "id string, name string, status string, created_at timestamp, updated_at timestamp"
ROUNDS = "analysis_id string, round_number int, file_name string, total_reads long"
STAGED = "analysis_id string, batch long, round_number int, sequence string, read_count long"
SEQUENCES = "analysis_id string, round_number int, sequence string, read_count long, percent_read double"


class Store:
    """Tables under one path. A round is replaced as a whole, by overwriting its partition."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 10_000):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _write(self, df: DataFrame, name: str, parts: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def analyses(self) -> DataFrame:
        return self._read("analyses", ANALYSES).filter("status != 'deleted'")

    def rounds(self) -> DataFrame:
        return self._read("rounds", ROUNDS).filter("total_reads >= 0")

    def sequences(self) -> DataFrame:
        return self._read("sequences", SEQUENCES)

    def create(self, name: str | None = None) -> str:
        now, key = datetime.now(UTC).replace(tzinfo=None), uuid.uuid4().hex
        row = [(key, name or now.date().isoformat(), "pending", now, now)]
        self._write(self.spark.createDataFrame(row, ANALYSES), "analyses", ["id"])
        return key

    def put_round(self, analysis_id: str, round_number: int, reads: DataFrame, file_name: str = "") -> None:
        """Store the most read sequences of ``reads`` (sequence, read_count) as a round, replacing it if it is there. A round without reads is one of 0 reads."""
        key = [F.lit(analysis_id).alias("analysis_id"), F.lit(round_number).alias("round_number")]
        total = reads.agg(F.sum("read_count").alias("total_reads")).select(*key, F.lit(file_name).alias("file_name"), F.coalesce("total_reads", F.lit(0)).alias("total_reads"))
        self._remove("sequences", f"analysis_id={analysis_id}/round_number={round_number}")
        self._write(total, "rounds", ["analysis_id", "round_number"])
        self._write(percent_top(reads, self.keep).select(*key, "sequence", "read_count", "percent_read"), "sequences", ["analysis_id", "round_number"])

    def put_rounds(self, analysis_id: str, reads: DataFrame, file_name: str = "") -> None:
        """Store all rounds of ``reads`` (round_number, sequence, read_count) at once, replacing those that are there."""
        key = F.lit(analysis_id).alias("analysis_id")
        totals = reads.groupBy("round_number").agg(F.sum("read_count").alias("total_reads"))
        self._write(totals.select(key, "round_number", F.lit(file_name).alias("file_name"), "total_reads"), "rounds", ["analysis_id", "round_number"])
        top = percent_top(reads, self.keep, ["round_number"])
        self._write(top.select(key, "round_number", "sequence", "read_count", "percent_read"), "sequences", ["analysis_id", "round_number"])

    def add_reads(self, analysis_id: str, reads: DataFrame, batch: int) -> None:
        """Add ``reads`` (round_number, sequence, read_count) to their rounds.

        Batches are kept as they came; one that comes again under its number replaces itself. A round is then stored anew from all of its batches.
        """
        parts = ["analysis_id", "batch", "round_number"]
        self._remove("staged", f"analysis_id={analysis_id}/batch={batch}")
        self._write(reads.select(F.lit(analysis_id).alias("analysis_id"), F.lit(batch).alias("batch"), "round_number", "sequence", "read_count"), "staged", parts)
        mine = self._read("staged", STAGED).filter(F.col("analysis_id") == analysis_id)
        touched = mine.filter(F.col("batch") == batch).select("round_number").distinct()
        rounds = mine.join(touched, "round_number", "left_semi").groupBy("round_number", "sequence").agg(F.sum("read_count").alias("read_count"))
        self.put_rounds(analysis_id, rounds)

    def list(self) -> DataFrame:
        """Analyses with their rounds nested, newest first."""
        nested = self.rounds().groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct("round_number", "file_name", "total_reads"))).alias("rounds"))
        a = self.analyses()
        return a.join(nested, a.id == nested.analysis_id, "left").drop("analysis_id").orderBy(F.col("created_at").desc(), "id")

    def detail(self, analysis_id: str, top: int = 10_000) -> DataFrame:
        """Rounds in order, each with its most read sequences."""
        mine = F.col("analysis_id") == analysis_id
        seqs = positions(self.sequences().filter(mine).drop("analysis_id"), ["round_number"], ["-read_count", "sequence"], "rank", "detail").filter(F.col("rank") <= top)
        rounds = self.rounds().filter(mine).select("round_number", "file_name", "total_reads")
        return rounds.join(seqs, "round_number", "left").orderBy("round_number", "rank")

    def delete(self, analysis_id: str) -> None:
        """Remove an analysis with its rounds and sequences."""
        for name, col in (("staged", "analysis_id"), ("sequences", "analysis_id"), ("rounds", "analysis_id"), ("analyses", "id")):
            self._remove(name, f"{col}={analysis_id}")

    def _remove(self, name: str, part: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{part}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
