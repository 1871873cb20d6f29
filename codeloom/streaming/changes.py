"""Streams of file changes and events; each has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def coalesced(events: DataFrame, window: str = "300 milliseconds", watermark: str | None = "10 seconds") -> DataFrame:
    """(window_start, path, op, events): one operation per path and window of (path, op, ts); a delete is not replaced by a later change."""
    e = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    rank = F.when(F.col("op") == "delete", 1).otherwise(0)
    return (
        e.groupBy(F.window("ts", window).alias("w"), "path")
        .agg(F.max(F.struct(rank.alias("r"), "ts", "op")).alias("m"), F.count("*").alias("events"))
        .select(F.col("w.start").alias("window_start"), "path", F.col("m.op").alias("op"), "events")
    )


def debounced(events: DataFrame, gap: str = "2 seconds", watermark: str | None = "10 seconds", key: str = "path") -> DataFrame:
    """(key, first_seen, last_seen, events): bursts of a key that end with a pause of `gap`."""
    e = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    return (
        e.groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("events"))
        .select(key, "first_seen", "last_seen", "events")
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """(window_start, event_type, events, total): tumbling or sliding event-time windows."""
    e = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def reconcile(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed, by path and content_hash; unchanged paths are left out."""
    a = stored.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("in_old"))
    b = seen.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def stale(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths present on both sides with other content."""
    return stored.select("path", F.col("content_hash").alias("old")).join(seen.select("path", F.col("content_hash").alias("new")), "path").where("old <> new").select("path")


def backoff_ms(attempt: Column, base: int = 1000, cap: int = 30_000) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2), attempt - 1)).cast("bigint")


def run_incremental(events: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch of changed paths, latest operation first, to `process` exactly once per batch id."""

    def each(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max(F.struct("ts", "op")).alias("m")).select("path", "m.op", "m.ts")
        process(last, batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
