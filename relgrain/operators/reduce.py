"""One aggregation per relation: the user's own aggregates, the automatic ones and the time features together."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import temporal
from ..functions.semantic import AFTER

if TYPE_CHECKING:
    from ..plans.spec import FeaturePolicy


@dataclass(frozen=True)
class Origin:
    """What is known of a column: its semantic type, the last function applied to it, and whether it is a label."""

    semantic: str
    func: str | None = None
    label: bool = False
    propagate: tuple[str, ...] = ()


def aggregate(name: str, func: str, semantic: str, policy: FeaturePolicy, order: str | None) -> Column:
    c = F.col(f"`{name}`")
    if semantic == "sequence_numerical":
        c = F.array_min(c) if func == "min" else F.array_max(c)
    if func == "sum" and semantic == "boolean":
        return F.count_if(c)
    match func:
        case "median":
            return F.percentile_approx(c, 0.5).cast("double") if policy.median == "approx" else F.median(c)
        case "mean" | "avg":
            return F.avg(c)
        case "nunique":
            return F.approx_count_distinct(c) if policy.distinct == "approx" else F.count_distinct(c)
        case "first":
            return F.min_by(c, F.when(c.isNotNull(), F.col(f"`{order}`"))) if order else F.first(c, ignorenulls=True)
        case "count" | "sum" | "min" | "max" | "mode" | "stddev":
            return getattr(F, func)(c)
    raise ValueError(f"unknown function {func!r}")


def auto_aggregates(
    origins: Mapping[str, Origin], skip: set[str], policy: FeaturePolicy, order: str | None
) -> tuple[list[Column], dict[str, Origin]]:
    """Aggregates of every column by its semantic type, or of aggregates by what may follow them. Names grow by a suffix."""
    out: list[Column] = []
    made: dict[str, Origin] = {}
    for name, o in origins.items():
        if name in skip or o.label:
            continue
        if o.func is None:
            functions = policy.functions.get(o.semantic, ())
        else:
            functions = tuple(f for f in AFTER.get(o.func, ()) if policy.hop_functions is None or f in policy.hop_functions or f == "first")
            if o.semantic == "timestamp":
                functions = tuple(f for f in functions if f in ("min", "max"))
        for f in functions:
            new = f"{name}_{f}"
            kind = "numerical" if f in ("count", "nunique", "median", "mean", "sum") else "numerical" if o.semantic in ("sequence_numerical", "identifier") else o.semantic
            out.append(aggregate(name, f, o.semantic, policy, order).alias(new))
            made[new] = Origin(kind, f)
    return out, made


def label_aggregates(origins: Mapping[str, Origin], policy: FeaturePolicy) -> tuple[list[Column], dict[str, Origin]]:
    """Labels below the target are carried up by sums and extremes, never as features."""
    out, made = [], {}
    for name, o in origins.items():
        if o.label:
            for f in o.propagate:
                new = f"{name}_{f}_label"
                out.append(aggregate(name, f, o.semantic, policy, None).alias(new))
                made[new] = Origin("numerical", f, True, o.propagate)
    return out, made


def time_features(prefix: str, name: str, kind: T.DataType, cut: datetime, lookback_days: float, policy: FeaturePolicy) -> tuple[list[Column], dict[str, Origin]]:
    """Recency, and events per lookback that the window covers, with ratios of neighbouring ones; all conditional
    aggregates of the same pass. A ratio to no events is null."""
    out, made = [], {}

    def add(c: Column, new: str, func: str) -> None:
        out.append(c.alias(new))
        made[new] = Origin("numerical", func)

    if policy.recency:
        add(temporal.seconds_since_last(name, kind, cut), f"{prefix}_seconds_since_last", "min")
    days = [d for d in policy.lookbacks if d <= lookback_days]
    count = {d: temporal.event_count(name, kind, cut, d) for d in days}
    if policy.counts:
        for d in days:
            add(count[d], f"{prefix}_num_events_{d}d", "sum")
    if policy.ratios:
        for a, b in zip(days, days[1:]):
            add(F.try_divide(count[a].cast("double"), count[b].cast("double")), f"{prefix}_{a}dv{b}_change", "mean")
    return out, made
