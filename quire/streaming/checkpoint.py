"""Resumable runs and event streams.

A checkpoint exists from a run's first batch, is appended to batch by batch, expires after seven days and is cleared once the output stands.
The windowed event aggregates are an extension for live corpora, with watermarks for late data."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sinks import append_checkpoint


def resume(units: DataFrame, checkpoint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, pending) of units(doc_key, unit_key, source) against checkpoint(doc_key, unit_key, translated)."""
    keys = ["doc_key", "unit_key"]
    return units.join(checkpoint, keys), units.join(checkpoint.select(*keys), keys, "left_anti")


def persist_batches(results: DataFrame, path: str, namespace: str, checkpoint_dir: str, handle: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch of results(doc_key, unit_key, translated) is handled once and appended; a restart repeats at most one batch, which then takes its own
    place in the table again: a batch is named by its stream's checkpoint and its number."""
    stream = f"{zlib.crc32(checkpoint_dir.encode()):08x}"

    def write(df: DataFrame, number: int) -> None:
        append_checkpoint(handle(df, number) if handle else df, path, namespace, batch=f"{stream}-{number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def expire(checkpoint: DataFrame, days: int = 7, now=None) -> DataFrame:
    now = F.current_timestamp() if now is None else F.lit(now)
    return checkpoint.where(F.col("saved_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def event_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by window and type; works on streams, where rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
