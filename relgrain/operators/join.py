"""Joins of the table graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, keep_key: bool = False) -> DataFrame:
    """parent ⟕ child on equal keys. The child's key is dropped; any other name that both have is an error."""
    clash = sorted({c.lower() for c in parent.columns} & {c.lower() for c in child.columns})
    if clash:
        raise ValueError(f"both sides of a join have {', '.join(clash)}")
    joined = parent.join(child, F.col(f"`{parent_key}`") == F.col(f"`{child_key}`"), "left")
    return joined if keep_key else joined.drop(child_key)


def with_existence(df: DataFrame, others: DataFrame, on: str, flag: str) -> DataFrame:
    """Add whether any row of ``others`` meets the condition, in one existence join.

    ``on`` is a condition over ``l`` (the row) and ``r`` (one of the others), which may hold ranges besides equal keys.
    The flag is never null.
    """
    return df.sparkSession.sql(f"SELECT l.*, EXISTS (SELECT 1 FROM {{others}} r WHERE {on}) AS `{flag}` FROM {{df}} l", df=df, others=others)


def where_exists(df: DataFrame, *any_of: tuple[DataFrame, str]) -> DataFrame:
    """Rows for which a row of any of the given frames meets its condition (as in ``with_existence``); one join each."""
    tests = [f"EXISTS (SELECT 1 FROM {{o{i}}} r WHERE {on})" for i, (_, on) in enumerate(any_of)]
    return df.sparkSession.sql(f"SELECT l.* FROM {{df}} l WHERE {' OR '.join(tests)}", df=df, **{f"o{i}": o for i, (o, _) in enumerate(any_of)})


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing when it is read if a key occurs twice."""
    many = df.groupBy(F.col(f"`{key}`").alias("__k")).agg(F.count("*").alias("__n"))
    checked = many.select("__k", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col("__k").cast("string")))).alias("__bad"))
    return df.join(checked, F.col(f"`{key}`").eqNullSafe(F.col("__k"))).filter(F.col("__bad").isNull()).drop("__k", "__bad")
