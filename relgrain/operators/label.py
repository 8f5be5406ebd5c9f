"""Labels: what happens after the cut."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ops import aggregates, compile_ops
from .reduce import aggregate

if TYPE_CHECKING:
    from ..plans.spec import FeaturePolicy, LabelSpec


def label_column(prefix: str, spec: LabelSpec, policy: FeaturePolicy) -> Column:
    name = f"{prefix}_{spec.field}"
    if callable(spec.op):
        return spec.op(F.col(f"`{name}`")).alias(f"{name}_label")
    if spec.op == "bool":
        return (F.count(f"`{name}`") >= 1).cast("int").alias(f"{name}_label")
    return aggregate(name, str(spec.op), "numerical", policy, None).alias(f"{name}_label")


def label_frames(rows: DataFrame, key: str, prefix: str, specs: Sequence[LabelSpec], policy: FeaturePolicy) -> list[tuple[DataFrame, list[tuple[LabelSpec, list[str]]]]]:
    """Labels per key from the rows after the cut, each frame with the columns that each spec brings.

    All labels of the same rows are made in one aggregation. Those by ops with ``where`` or ``having`` are of other
    rows, and those with ``reduce=False`` are a label per row: each of them is a frame of its own.
    """
    together: list[tuple[LabelSpec, list[Column]]] = []
    out = []
    for spec in specs:
        if isinstance(spec.op, tuple):
            if any(o.kind not in ("where", "agg", "having") for o in spec.op):
                raise ValueError("a label's ops are where, agg and having")
            if all(o.kind == "agg" for o in spec.op):
                together.append((spec, aggregates(spec.op)))
                continue
        elif spec.reduce:
            together.append((spec, [label_column(prefix, spec, policy)]))
            continue
        df = label_frame(rows, key, prefix, spec, policy)
        out.append((df, [(spec, [c for c in df.columns if c != key])]))
    if together:
        df = rows.groupBy(F.col(f"`{key}`")).agg(*[c for _, columns in together for c in columns])
        names, parts = iter([c for c in df.columns[1:]]), []
        for spec, columns in together:
            parts.append((spec, [next(names) for _ in columns]))
        twice = {c for c in df.columns if df.columns.count(c) > 1}
        if twice:
            raise ValueError(f"two labels are called {', '.join(sorted(twice))}")
        out.insert(0, (df, parts))
    return out


def label_frame(rows: DataFrame, key: str, prefix: str, spec: LabelSpec, policy: FeaturePolicy) -> DataFrame:
    """One label per key; with ``reduce=False`` a label per row."""
    if isinstance(spec.op, tuple):
        wheres = [o for o in spec.op if o.kind == "where"]
        out = (compile_ops(rows, wheres) if wheres else rows).groupBy(F.col(f"`{key}`")).agg(*aggregates(spec.op))
        for o in spec.op:
            out = out.filter(F.expr(o.expr)) if o.kind == "having" else out
        return out
    name = f"{prefix}_{spec.field}"
    if callable(spec.op):
        value = spec.op(F.col(f"`{name}`"))
    elif spec.op in ("bool", "count"):
        value = F.col(f"`{name}`").isNotNull().cast("int")
    else:
        value = F.col(f"`{name}`")  # of one row, its sum, extremes and mean are the value
    return rows.select(F.col(f"`{key}`"), value.alias(f"{name}_label"))
