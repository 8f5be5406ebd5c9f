"""Frozen descriptions of tables, edges, windows, features and labels. They hold no data and run nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.period import period
from ..functions.semantic import FUNCTIONS
from ..sources.store import Store

KEYWORDS = {"select": "select", "where": "where", "key": "group by", "agg": "", "having": "having", "order": "order by", "window": "", "custom": ""}


@dataclass(frozen=True)
class Op:
    """A fragment of a query: kind and expression text, without the keyword. ``custom`` is a whole query over ``{this}``."""

    kind: str
    expr: str

    def __post_init__(self) -> None:
        if self.kind not in KEYWORDS:
            raise ValueError(f"unknown kind of op {self.kind!r}; known are {', '.join(KEYWORDS)}")
        word = KEYWORDS[self.kind]
        if word and self.expr.strip().lower().startswith(word + " "):
            raise ValueError(f"the expression of a {self.kind!r} op goes without {word!r}")


@dataclass(frozen=True)
class Hook:
    """A step of the user's own: a function of a DataFrame, or ops. It waits until all of ``requires`` are joined in.

    With ``checkpoint`` or a ``store`` the lineage is cut behind it.
    """

    fn: Callable[[DataFrame], DataFrame] | None = None
    ops: tuple[Op, ...] = ()
    requires: tuple[str, ...] = ()
    checkpoint: bool = False
    store: Store | None = None  #: where its result is kept, as ``name``, and read from again
    name: str | None = None

    def __post_init__(self) -> None:
        if (self.fn is None) == (not self.ops):
            raise ValueError("a hook has either a function or ops")
        if (self.store is None) != (self.name is None):
            raise ValueError("a hook's result is kept in a store under a name")


@dataclass(frozen=True)
class Source:
    """Where a table's rows come from: a path with a format, a table of the catalog, or a function of the session."""

    path: str | None = None
    format: str = "parquet"
    options: Mapping[str, Any] = field(default_factory=dict)
    schema: str | None = None
    table: str | None = None
    fn: Callable[[SparkSession], DataFrame] | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.path, self.table, self.fn)) != 1:
            raise ValueError("a source is exactly one of path, table and fn")


Steps = tuple["Hook | Op | Callable[[DataFrame], DataFrame]", ...]


@dataclass(frozen=True)
class Table:
    """One table of the graph. Columns are named ``{prefix}_{column}`` from loading on; ``key`` and ``time`` are given bare."""

    name: str
    source: Source
    prefix: str
    key: str
    time: str | None = None
    columns: tuple[str, ...] | None = None
    annotate: Steps = ()
    filter: Steps = ()
    normalize: Steps = ()
    reduce: tuple["Op | Callable[[], Column]", ...] = ()  #: aggregates of the user's own
    after_join: tuple[Hook, ...] = ()
    after_join_reduce: tuple[Op, ...] = ()
    window: Window | None = None
    time_series: bool | str = True  #: True, False, or "auto" to count keys and rows
    binary_columns: frozenset[str] = frozenset()  #: 0/1 columns, summed as flags are

    def alias(self, prefix: str, name: str | None = None) -> Table:
        """The same rows in a namespace of their own, to be joined a second time. Ops name columns by prefix, so none are kept."""
        return replace(self, prefix=prefix, name=name or prefix, annotate=(), filter=(), normalize=(), reduce=(), after_join=(), after_join_reduce=())


@dataclass(frozen=True)
class Edge:
    """child.child_key refers to parent.parent_key."""

    parent: str
    child: str
    parent_key: str
    child_key: str
    reduce: bool = True
    reduce_after_join: bool = False
    windowed: bool = True
    relation: str = "parent_child"

    def __post_init__(self) -> None:
        if self.reduce and self.reduce_after_join:
            raise ValueError("an edge is reduced before the join or after it, not both")
        if self.relation not in ("parent_child", "peer"):
            raise ValueError(f"unknown relation {self.relation!r}")


@dataclass(frozen=True)
class Window:
    """Features are from ``(cut - lookback, cut)``, labels from ``(cut, cut + horizon)``."""

    cut: datetime
    lookback: tuple[float, str] = (365, "day")
    horizon: tuple[float, str] | None = None
    null_time: str = "keep"

    def __post_init__(self) -> None:
        if not isinstance(self.cut, datetime):
            raise TypeError("the cut is a datetime")
        if self.null_time not in ("keep", "drop"):
            raise ValueError("null_time is keep or drop")
        period(*self.lookback)
        if self.horizon:
            period(*self.horizon)

    @property
    def back(self) -> timedelta:
        return period(*self.lookback)

    @property
    def ahead(self) -> timedelta:
        if not self.horizon:
            raise ValueError("labels need a horizon")
        return period(*self.horizon)


@dataclass(frozen=True)
class FeaturePolicy:
    enabled: bool = True
    functions: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(FUNCTIONS))
    lookbacks: tuple[int, ...] = (1, 3, 4, 7, 14, 30, 60, 90, 180, 365, 730)
    counts: bool = True  #: events per lookback
    ratios: bool = True  #: of adjacent lookbacks
    recency: bool = True
    gaps: bool = False
    median: str = "exact"  #: or "approx"
    distinct: str = "exact"  #: or "approx"
    hop_functions: tuple[str, ...] | None = None  #: restricts aggregates of aggregates
    max_columns: int | None = None


OFF = FeaturePolicy(enabled=False)


@dataclass(frozen=True)
class LabelSpec:
    """A label of a table's rows after the cut: an operation on a field, a function of its column, or ops."""

    table: str
    op: "str | Callable[[Column], Column] | tuple[Op, ...]"
    field: str | None = None
    reduce: bool = True
    fill: Any = None
    propagate: tuple[str, ...] = ("sum", "min", "max")  #: how labels of tables further away are carried to the target

    def __post_init__(self) -> None:
        if not isinstance(self.op, tuple) and self.field is None:
            raise ValueError("a label by an operation needs a field")
        if isinstance(self.op, str) and self.op not in ("count", "sum", "min", "max", "mean", "avg", "median", "nunique", "first", "bool"):
            raise ValueError(f"unknown label operation {self.op!r}")


@dataclass(frozen=True)
class EntityGraph:
    tables: tuple[Table, ...]
    edges: tuple[Edge, ...]
    target: str
    window: Window
    policy: FeaturePolicy = OFF
    labels: tuple[LabelSpec, ...] = ()
    back_hops: int | None = None
    front_hops: int = 0
    target_filter: bool = False
    check_unique: bool = False

    def __post_init__(self) -> None:
        names = [t.name for t in self.tables]
        for what, values in (("name", names), ("prefix", [t.prefix for t in self.tables])):
            twice = {v for v in values if values.count(v) > 1}
            if twice:
                raise ValueError(f"the {what} {', '.join(sorted(twice))} is used by more than one table")
        used = [self.target, *(l.table for l in self.labels), *(x for e in self.edges for x in (e.parent, e.child))]
        unknown = sorted({x for x in used if x not in names})
        if unknown:
            raise ValueError(f"no such table: {', '.join(unknown)}")
        if self.labels and not self.window.horizon:
            raise ValueError("labels need a horizon")

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    def window_of(self, table: Table) -> Window:
        own = table.window
        if own is None:
            return self.window
        return replace(own, horizon=own.horizon or self.window.horizon)

    def children(self, name: str) -> tuple[Edge, ...]:
        return tuple(dict.fromkeys(e for e in self.edges if e.parent == name))

    def parents(self, name: str) -> tuple[Edge, ...]:
        return tuple(dict.fromkeys(e for e in self.edges if e.child == name))

    def descendants(self, name: str) -> tuple[Edge, ...]:
        """All edges below a table, in the order in which they are met; each once, however many ways lead to it."""
        out, left = {}, [name]
        while left:
            for e in self.children(left.pop()):
                if e not in out:
                    out[e] = None
                    left.append(e.child)
        return tuple(out)

    def levels_up(self, start: str) -> list[list[str]]:
        """Tables above ``start`` level by level, farthest first."""
        levels, seen, now = [], {start}, [start]
        while now:
            now = list(dict.fromkeys(e.parent for n in now for e in self.parents(n) if e.parent not in seen))
            seen |= set(now)
            if now:
                levels.append(now)
        return levels[::-1]
