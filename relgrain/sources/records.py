"""Records that are stored more than once: exact copies, or delivered again with a later ``loaded_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(df: DataFrame, columns: dict[str, Column | str], key: str = "id", loaded: str | None = "loaded_at") -> DataFrame:
    """One row per record: ``key``, the named columns and, where asked for, the earliest ``loaded``.

    Copies of a key agree in every other column; that is the contract of the tables. So texts are grouped by, which
    takes a hash aggregate where a maximum of texts would take a sort, and the rest is combined by ``max``. Copies are
    combined before the shuffle: a record stored very often costs a row per map task. Rows without a key can't be told
    to be copies, so each stays a record of its own.
    """
    named = {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    rows = df.select(F.col(key).alias("__id"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("__n"), *[c.alias(n) for n, c in named.items()], *([F.col(loaded).alias("__loaded")] if loaded else []))
    texts = [n for n, kind in rows.dtypes if n in named and kind == "string"]
    aggs = [F.max(n).alias(n) for n in named if n not in texts] + ([F.min("__loaded").alias(loaded)] if loaded else [])
    by = ["__id", "__n", *texts]
    out = rows.groupBy(*by).agg(*aggs) if aggs else rows.select(*by).distinct()
    return out.select(F.col("__id").alias(key), *named, *([loaded] if loaded else []))
