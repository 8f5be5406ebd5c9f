"""What a column's values can be summed as without losing anything."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def number_kind(df: DataFrame, column: str) -> tuple[str, int]:
    """``("whole", 0)``, ``("decimal", scale)`` or ``("floating", 0)``; anything else is an error, never cast silently."""
    kind = dict(df.dtypes)[column]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "whole", 0
    if kind in ("float", "double"):
        return "floating", 0
    if m := re.fullmatch(r"decimal\(\d+,(\d+)\)", kind):
        return "decimal", int(m.group(1))
    raise TypeError(f"{column} is {kind}: only whole numbers, decimals and floating numbers can be summed")
