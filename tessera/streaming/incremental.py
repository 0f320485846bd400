"""Incremental forms of batch operators on Structured Streaming; state is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_arrivals(stream: DataFrame, key: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark: the streaming fetch registry."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, event_time: str, by: list[str], length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window_start, by..., n) of tumbling windows; also runs on a batch table."""
    timed = events.withWatermark(event_time, delay) if events.isStreaming else events
    counts = timed.groupBy(F.window(event_time, length), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *by, "n")


def session_counts(events: DataFrame, event_time: str, by: list[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(by..., session_start, session_end, n); a session ends ``gap`` after its last event."""
    timed = events.withWatermark(event_time, delay) if events.isStreaming else events
    counts = timed.groupBy(F.session_window(event_time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def upsert(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of new rows to ``apply``, such as a keyed merge into a stored table."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
