"""Semantic types, from the schema alone: no sampling and no jobs."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import types as T

#: The functions by which columns of a semantic type are aggregated.
FUNCTIONS = {
    "numerical": ("median", "mean", "sum", "min", "max"),
    "categorical": ("count", "nunique"),
    "boolean": ("count", "sum"),
    "timestamp": ("min", "max"),
    "sequence_numerical": ("min", "max"),
    "embedding": ("first",),
    "multicategorical": ("first",),
    "identifier": ("count",),
    "opaque": (),
}

#: The functions that may follow a function when an aggregate is aggregated again.
AFTER = {
    **{f: ("min", "max", "mean", "sum") for f in ("count", "nunique", "median", "mean", "sum", "min", "max")},
    "first": ("first",),
}


def semantic_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numerical"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            return "embedding"
        return "sequence_numerical" if isinstance(kind.elementType, T.IntegralType) else "multicategorical"
    if isinstance(kind, (T.MapType, T.StructType, T.VariantType)):
        return "opaque"
    return "categorical"


def is_identifier(name: str, declared: Collection[str] = ()) -> bool:
    """Declared keys, and names that by custom are ids. ``name`` is without prefix."""
    low = name.lower()
    return name in declared or low.split("_")[-1].endswith("id") or low in ("uuid", "guid", "identifier") or low.endswith("key")
