"""Totals over trailing periods, per entity and day, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .exact import number_kind

#: Daily totals of whole numbers are summed in three parts, each of so many decimal digits, as whole numbers of 64 bits.
_DIGITS = 12


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, periods: tuple[int, ...] = (7, 30), max_days: int = 100_000) -> DataFrame:
    """One row per entity and day from the entity's first day to its last: ``n_{p}d``, ``sum_{p}d``, ``avg_{p}d``.

    ``day`` is an integer day number; a period of p days is the day itself and the p - 1 before it. Counts are of
    rows; sums and averages are over the values that are not null and null where there are none. Sums of whole numbers
    are exact ``decimal(38,0)``, those of decimals exact decimals of their scale, those of floating numbers doubles;
    values of another type are an error. Rows without entity or day have no place in the calendar and are left out.
    Columns of ``df`` other than the three named don't matter; an empty table gives an empty result. (If the entity's
    column is called ``day``, the day comes out as ``on_day``.)

    An entity with more than ``max_days`` days from first to last is an error that names it when the result is read: a
    single stray date, of the year 1 say, would otherwise bring a row for each day since.

    Rows become daily totals first, combined before the shuffle, so an entity with any share of the rows is at most a
    row per day. Each daily total is exploded onto the output days it influences, and the calendar's days join as
    contributions of nothing: each daily total also brings the days up to the next one, so the calendar needs no table
    and no shuffle of its own. The daily totals are shuffled once more, by entity; all the exploded rows are made and
    grouped where they are.
    """
    longest, (kind, _) = max(periods), number_kind(df, value)
    daily = (
        df.select(F.col(entity).alias("__e"), F.col(day).cast("int").alias("__d"), F.col(value).cast({"whole": "decimal(20,0)", "floating": "double"}.get(kind, dict(df.dtypes)[value])).alias("__v"))
        .filter(F.col("__e").isNotNull() & F.col("__d").isNotNull())
        .groupBy("__e", "__d")
        .agg(F.count("*").alias("__n"), F.count("__v").alias("__k"), F.sum("__v").alias("__s"))
    )
    if kind == "whole":
        daily = _parted(daily)
    parts = ["__s0", "__s1", "__s2"] if kind == "whole" else ["__s"]
    # An explicit number of partitions: the rows grow about thirtyfold after this shuffle, which adaptive coalescing can't foresee.
    daily = daily.repartition(shuffle_partitions(df.sparkSession), "__e")
    by = Window.partitionBy("__e")
    daily = daily.withColumns({"__next": F.lead("__d").over(by.orderBy("__d")), "__last": F.max("__d").over(by), "__first": F.min("__d").over(by)})
    days = F.col("__last") - F.col("__first") + 1
    told = F.concat(F.lit("entity "), F.col("__e").cast("string"), F.lit(" has "), days.cast("string"), F.lit(f" days from first to last, more than {max_days}"))
    until = F.greatest(F.least(F.col("__d") + longest - 1, "__last"), F.coalesce(F.col("__next") - 1, "__d"))
    until = F.when(days > max_days, F.raise_error(told).cast("int")).otherwise(until)
    spread = daily.select("__e", "__d", "__n", "__k", *parts, F.explode(F.sequence("__d", until)).alias("__o"))
    aggs = []
    for p in periods:
        inside = F.col("__o") - F.col("__d") < p
        aggs += [F.sum(F.when(inside, F.col("__n")).otherwise(0)).alias(f"n_{p}d"), F.sum(F.when(inside, F.col("__k")).otherwise(0)).alias(f"__k{p}")]
        aggs += [F.sum(F.when(inside, F.col(s))).alias(f"{s}_{p}") for s in parts]
    out = spread.groupBy("__e", "__o").agg(*aggs)
    columns = [F.col("__e").alias(entity), F.date_from_unix_date("__o").alias("day" if entity != "day" else "on_day")]
    for p in periods:
        total = F.when(F.col(f"__k{p}") > 0, _whole(p) if kind == "whole" else F.col(f"__s_{p}"))
        columns += [F.col(f"n_{p}d"), total.alias(f"sum_{p}d"), F.when(F.col(f"__k{p}") > 0, total.cast("double") / F.col(f"__k{p}")).alias(f"avg_{p}d")]
    return out.select(*columns)


def _parted(daily: DataFrame) -> DataFrame:
    """The total in parts that are whole numbers of 64 bits; adding those up thirtyfold is what takes the time."""
    base = f"CAST({10**_DIGITS} AS DECIMAL({_DIGITS + 1},0))"
    rest = lambda x: f"CAST({x} % {base} AS DECIMAL(18,0))"
    above = lambda x, low: f"CAST((CAST({x} AS DECIMAL(37,0)) - {low}) / {base} AS DECIMAL(30,0))"
    out = daily.withColumn("__low", F.expr(rest("__s"))).withColumn("__up", F.expr(above("__s", "__low")))
    out = out.withColumn("__mid", F.expr(rest("__up")))
    big = F.expr(f"CAST({above('__up', '__mid')} AS BIGINT)")
    return out.select("__e", "__d", "__n", "__k", F.col("__low").cast("bigint").alias("__s0"), F.col("__mid").cast("bigint").alias("__s1"), big.alias("__s2"))


def _whole(p: int):
    wide = lambda k: f"CAST(CAST(__s{k}_{p} AS DECIMAL(19,0)) * CAST(1{'0' * (_DIGITS * k)} AS DECIMAL({_DIGITS * k + 1},0)) AS DECIMAL(36,0))"
    return F.expr(f"CAST({wide(2)} + {wide(1)} + {wide(0)} AS DECIMAL(38,0))")
