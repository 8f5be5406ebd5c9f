"""Point-in-time predicates and features of event times. All bounds are strict: an event at the cut is on neither side."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment(at: datetime, kind: T.DataType) -> Column:
    """A literal of the column's own type, so that it can be compared in the scan. Naive times are UTC."""
    at = at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit((at - datetime(1970, 1, 1)) // timedelta(microseconds=1)))
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def event_time(name: str, kind: T.DataType) -> Column:
    """The column as a time; a date is the start of its day, a text that isn't a time is null."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c
    return F.try_to_timestamp(c).cast("timestamp_ntz") if isinstance(kind, T.StringType) else c.cast("timestamp_ntz")


def in_features(name: str, kind: T.DataType, cut: datetime, lookback: timedelta, null_time: str = "keep") -> Column:
    """``cut - lookback < t < cut``; rows without a time stay unless ``null_time`` is ``drop``."""
    t = event_time(name, kind)
    inside = (t > moment(cut - lookback, kind)) & (t < moment(cut, kind))
    return inside | t.isNull() if null_time == "keep" else inside


def in_label(name: str, kind: T.DataType, cut: datetime, horizon: timedelta) -> Column:
    """``cut < t < cut + horizon``; rows without a time are never labels."""
    t = event_time(name, kind)
    return (t > moment(cut, kind)) & (t < moment(cut + horizon, kind))


def micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970, in UTC for times without zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def event_count(name: str, kind: T.DataType, cut: datetime, days: int) -> Column:
    """Events of the last ``days`` days: ``cut - days <= t <= cut``."""
    t = event_time(name, kind)
    return F.sum(F.when((t >= moment(cut - timedelta(days=days), kind)) & (t <= moment(cut, kind)), 1).otherwise(0))


def seconds_since_last(name: str, kind: T.DataType, cut: datetime) -> Column:
    t = event_time(name, kind)
    return F.timestamp_diff("SECOND", F.max(t), moment(cut, kind))


def with_gaps(rows: DataFrame, history: DataFrame, name: str, kind: T.DataType, by: str, out: str, lookback: timedelta, cut: datetime, bounded: bool = True, ties: Sequence[str] = (), pieces: int = 64) -> DataFrame:
    """``rows`` with the seconds since the event before with the same key; it looks back only, so it leaks nothing.

    ``rows`` are those of ``history`` in the window (``bounded``) or all of them. An event's predecessor is the one before
    it in its piece of time, of which a lookback has ``pieces``, or else the latest of the key's earlier pieces; what
    came before the window is one piece. So the window's bounds still reach the scan of ``rows``, history is read once
    more for a latest time per key and piece, which is combined before the shuffle, and a key with any share of the
    rows is spread over its pieces. Rows without time have no gap.
    """
    t = event_time(name, kind)
    began = moment(cut - lookback, kind)
    width = max(1, lookback // timedelta(microseconds=1) // pieces)
    piece = F.floor((micros(t, kind) - micros(began, kind)) / width).cast("bigint")
    piece = F.when(t <= began, F.lit(-1).cast("bigint")).otherwise(piece) if bounded else piece
    key = F.col(f"`{by}`")
    latest = history.filter(t < moment(cut, kind)) if bounded else history.filter(t.isNotNull())
    latest = latest.groupBy(key.alias("__key"), piece.alias("__in")).agg(F.max(t).alias("__last"))
    earlier = F.max("__last").over(W.partitionBy("__key").orderBy("__in").rowsBetween(W.unboundedPreceding, -1))
    latest = latest.select("__key", "__in", earlier.alias("__before")).filter("__before is not null")
    within = F.lag(t).over(W.partitionBy(key, "__piece").orderBy(t, *[F.col(f"`{x}`") for x in ties]))
    marked = rows.withColumn("__piece", piece)
    marked = marked.join(latest, (key == F.col("__key")) & (F.col("__piece") == F.col("__in")), "left").withColumn("__lag", within)
    gap = F.timestamp_diff("SECOND", F.coalesce("__lag", "__before"), t)
    return marked.withColumn(out, gap).drop("__piece", "__key", "__in", "__before", "__lag")


def clean_times(df: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """Rows whose column is a time, as ``timestamp_ntz`` in the session's zone, and an aggregate over ``df``: the percentage of rows left out."""
    t = event_time(name, df.schema[name].dataType).cast("timestamp_ntz")
    return df.withColumn(name, t).filter(F.col(f"`{name}`").isNotNull()), (F.avg(F.when(t.isNull(), 100.0).otherwise(0.0))).alias("percent_removed")
