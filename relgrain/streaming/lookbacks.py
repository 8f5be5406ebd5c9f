"""Events per entity over sliding lookbacks of a stream, late events allowed for by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_counts(events: DataFrame, entity: str, time: str, lookback: str = "7 days", slide: str = "1 day", late: str = "1 day", value: str | None = None) -> DataFrame:
    """``entity, cut, num_events[, total]``: for each cut, a multiple of ``slide``, the events from ``lookback`` before it.

    Events later than the watermark are left out; state is dropped once the watermark has passed a window. Works on a
    stream (append or update mode) and, with the same result, on a table.
    """
    window = F.window(F.col(time).cast("timestamp"), lookback, slide)
    aggs = [F.count("*").alias("num_events")] + ([F.sum(value).alias("total")] if value else [])
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(window.alias("w"), F.col(entity)).agg(*aggs).select(entity, F.col("w.end").alias("cut"), *[a for a in ("num_events", "total") if a == "num_events" or value])
