"""Structured Streaming extension: rounds that arrive as files, and enrichment by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aptaforge.sources.reads import collapse
from aptaforge.sources.store import Store


def window_counts(events: DataFrame, size: str = "1 day", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """Counts of each event type and user by window, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def follow_reads(reads: DataFrame, store: Store, analysis_id: str, checkpoint: str) -> StreamingQuery:
    """Add each micro-batch of a stream (round_number, sequence, read_count) to the stored rounds that it holds. A batch that is run again after a
    failure replaces itself, so reads count once."""

    def put(batch: DataFrame, number: int) -> None:
        store.add_reads(analysis_id, collapse(batch, ["round_number"]), number)

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
