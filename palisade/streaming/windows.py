"""Windowed rates and duplicate removal on streams, with watermarks bounding the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.metrics import events_per_second


def event_rates(stream: DataFrame, ts: str, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """Events per second over event-time windows; later rows than ``late`` are dropped."""
    return events_per_second(stream.withWatermark(ts, late), ts, seconds)


def sliding_rates(stream: DataFrame, ts: str, seconds: int = 5, every: int = 1, late: str = "1 minute") -> DataFrame:
    """Events of the last ``seconds`` and their rate at every border of ``every`` seconds: at_ms, events, eps."""
    span = F.window(ts, f"{seconds} seconds", f"{every} seconds")
    return stream.withWatermark(ts, late).groupBy(span.alias("w")).agg(F.count("*").alias("events")).selectExpr(
        "unix_millis(w.end) as at_ms", "events", f"round(events / {float(seconds)}D, 1) as eps")


def dedupe_stream(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row per event_id; ids are remembered for the watermark delay."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_id"])
