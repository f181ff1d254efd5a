"""Evidence from a stream: identifiers once within a watermark, counted by direction and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions.columns import recode


def evidence_stream(events: DataFrame, codes: dict[str, str], late: str = "1 hour", key: str = "user_id", code: str = "event_type", value: str = "event_id", time: str = "ts") -> DataFrame:
    """Known directions only, each identifier once; rows later than the watermark are dropped."""
    known = events.withWatermark(time, late).select(key, recode(code, codes).alias("direction"), value, time).filter("direction IS NOT NULL")
    return known.dropDuplicatesWithinWatermark([key, "direction", value])


def evidence_counts(stream: DataFrame, window: str = "1 day", time: str = "ts") -> DataFrame:
    """(window, direction, n): complete when the watermark has passed a window."""
    return stream.groupBy(F.window(time, window), "direction").agg(F.count(F.lit(1)).alias("n"))
