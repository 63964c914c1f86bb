"""Incremental audits: passages arrive as files, findings leave by batch, and totals run on. Event-time operators are extensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def passage_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Passages of a folder of Parquet files, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def audit_stream(passages: DataFrame, audit: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Audits each batch of passages and hands its findings on; a failure of one passage is a row of what `audit` returns."""
    return passages.writeStream.foreachBatch(lambda batch, n: emit(audit(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(findings: DataFrame, key: str) -> DataFrame:
    """Findings and passages so far, exactly, for an output in complete mode.

    A stream can't count distinct values, so a key's state holds its passage ids: as many as the document has passages.
    """
    return findings.groupBy(key).agg(F.count("*").alias("findings_total"), F.size(F.collect_set("passage_id")).cast("long").alias("passages"))


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes", step: str | None = None) -> DataFrame:
    """Counts and sums by event type in event-time windows; rows later than the watermark are left out."""
    window = F.window(ts, size, step) if step else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each key in sessions that end after a gap."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of the events with one key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
