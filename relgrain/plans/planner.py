"""The planner: an ordered list of steps from the spec alone, folded to one lazy DataFrame."""

from __future__ import annotations

import html
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import temporal
from ..functions.semantic import is_identifier, semantic_type
from ..operators.join import left_join, require_unique
from ..operators.label import label_frames
from ..operators.ops import aggregates, compile_ops
from ..operators.reduce import Origin, auto_aggregates, label_aggregates, time_features
from ..session import as_view, checkpoint
from ..sources.readers import load
from .spec import Edge, EntityGraph, Hook, LabelSpec, Op, Table


@dataclass(frozen=True)
class Step:
    action: str
    table: str
    edge: Edge | None = None
    hooks: tuple[Hook, ...] = ()
    labels: tuple[LabelSpec, ...] = ()

    def __str__(self) -> str:
        e = self.edge
        match self.action:
            case "load":
                return f"load {self.table}"
            case "front":
                return f"front join {e.child} <- {e.parent} on {e.child_key} = {e.parent_key}"
            case "reduce":
                return f"reduce {e.child} by {e.child_key}"
            case "join":
                return f"join {e.parent} <- {e.child} on {e.parent_key} = {e.child_key}" + ("" if e.reduce else " (rows)")
            case "label":
                return f"label {e.parent} by {e.child}: " + ", ".join(l.op if isinstance(l.op, str) else "custom" for l in self.labels)
            case "hook":
                return f"after join on {self.table}" + (f", requires {', '.join(self.hooks[0].requires)}" if self.hooks[0].requires else "")
        return f"{self.action} {self.table}"


@dataclass
class Frame:
    """A table's rows with what is known of their columns; ``base`` is before anything was joined in."""

    df: DataFrame
    origins: dict[str, Origin]
    base: DataFrame
    joined: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class Plan:
    graph: EntityGraph
    steps: tuple[Step, ...]

    def explain(self) -> str:
        """The steps, one a line. Nothing is read."""
        return "\n".join(f"{n}. {s}" for n, s in enumerate(self.steps, 1))

    def mermaid(self) -> str:
        """The graph as a Mermaid flow chart."""
        names = {t.name: f"t{i}" for i, t in enumerate(self.graph.tables)}
        used = {s.edge for s in self.steps if s.edge}
        label = lambda text: text.replace('"', "#quot;")
        lines = ["flowchart TD"]
        lines += [f'  {names[t.name]}["{label(f"{t.name} ({t.prefix})")}"]' + (":::target" if t.name == self.graph.target else "") for t in self.graph.tables]
        lines += [f'  {names[e.child]} {"-->" if e in used else "-.->"}|"{label(f"{e.child_key} = {e.parent_key}")}"| {names[e.parent]}' for e in self.graph.edges]
        return "\n".join([*lines, "  classDef target stroke-width:3px"])

    def html(self) -> str:
        """A page that shows the graph by itself: tables in rows by their distance from the target, edges with what
        they join on, those that are not used dashed, and the steps below."""
        g, used = self.graph, {s.edge for s in self.steps if s.edge}
        level = {g.target: 0}
        for e in (*g.descendants(g.target), *(s.edge for s in self.steps if s.action == "front")):
            near, far = (e.parent, e.child) if e.child not in level else (e.child, e.parent)
            level.setdefault(far, level.get(near, 0) + (1 if far == e.child else -1))
        rows: dict[int, list[str]] = {}
        for t in g.tables:
            rows.setdefault(level.get(t.name, max(level.values()) + 1), []).append(t.name)
        place = {name: (110 + 200 * k, 40 + 110 * i) for i, (_, names) in enumerate(sorted(rows.items())) for k, name in enumerate(names)}
        parts = []
        for e in g.edges:
            (x1, y1), (x2, y2) = place[e.child], place[e.parent]
            said = html.escape(f"{e.child}.{e.child_key} = {e.parent}.{e.parent_key}")
            parts.append(f'<line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="#555"{"" if e in used else " stroke-dasharray=\'6 4\'"}><title>{said}</title></line>')
            parts.append(f'<text x="{(x1 + x2) // 2}" y="{(y1 + y2) // 2}" font-size="11">{html.escape(f"{e.child_key} = {e.parent_key}")}</text>')
        for name, (x, y) in place.items():
            wide = 3 if name == g.target else 1
            parts.append(f'<rect x="{x - 85}" y="{y - 18}" width="170" height="36" fill="#fff" stroke="#000" stroke-width="{wide}"/>')
            parts.append(f'<text x="{x}" y="{y + 4}" text-anchor="middle">{html.escape(f"{name} ({g.table(name).prefix})")}</text>')
        size = f'width="{max(x for x, _ in place.values()) + 110}" height="{max(y for _, y in place.values()) + 40}"'
        steps = html.escape(self.explain())
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(g.target)}</title></head><body><svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif" font-size="13">{"".join(parts)}</svg><pre>{steps}</pre></body></html>'

    def run(self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None, view: str | None = None) -> DataFrame:
        """The target's rows with features and labels, as one lazy DataFrame. ``frames`` stand in for sources by table name.

        With ``view`` it is also a view of the session, for SQL; ``session.release`` drops it.
        """
        df = _Run(self, spark, frames or {}).result()
        return as_view(df, view) if view else df

    def columns(self, spark: SparkSession, schemas: Mapping[str, T.StructType]) -> T.StructType:
        """Names and types of the result for sources of these schemas. No job runs."""
        return self.run(spark, {n: spark.createDataFrame([], s) for n, s in schemas.items()}).schema


def plan(graph: EntityGraph) -> Plan:
    """Bottom-up order of the graph below the target: post-order, each table in its first place found.

    A table that is reached twice is joined once; the edge left out is warned of. ``Table.alias`` gives the same rows
    a second place.
    """
    walk: list[Edge] = []
    seen = {graph.target}

    def down(name: str, depth: int) -> None:
        for e in graph.children(name):
            if graph.back_hops is not None and depth >= graph.back_hops:
                return
            if e.child in seen:
                warnings.warn(f"{e.child} is joined already; the edge to {e.parent} is left out, alias the table to keep it", stacklevel=2)
                continue
            seen.add(e.child)
            down(e.child, depth + 1)
            walk.append(e)

    down(graph.target, 0)
    front: list[Edge] = []

    def up(name: str, hops: int) -> None:
        for e in graph.parents(name) if hops else ():
            if e.parent not in seen:
                seen.add(e.parent)
                up(e.parent, hops - 1)
                front.append(e)

    up(graph.target, graph.front_hops)
    steps = [Step("load", t.name) for t in graph.tables if t.name in seen]
    steps += [Step("front", e.child, e) for e in front]
    left = {n: sum(e.parent == n for e in walk) for n in seen}
    joined: dict[str, set[str]] = {n: set() for n in seen}
    waiting = {t.name: [h if isinstance(h, Hook) else Hook(fn=h) for h in t.after_join] for t in graph.tables if t.name in seen}
    for name in seen:
        unknown = [x for h in waiting[name] for x in h.requires if x not in {t.name for t in graph.tables}]
        if unknown:
            raise ValueError(f"a hook of {name} requires {', '.join(unknown)}, which is no table")
    for e in walk:
        if e.reduce:
            steps.append(Step("reduce", e.child, e))
        steps.append(Step("join", e.parent, e))
        labels = tuple(l for l in graph.labels if l.table == e.child)
        if labels:
            steps.append(Step("label", e.parent, e, labels=labels))
        if e.reduce_after_join:
            steps.append(Step("reduce after join", e.parent, e))
        joined[e.parent] |= {e.child} | joined[e.child]
        left[e.parent] -= 1
        for h in list(waiting[e.parent]):
            if set(h.requires) <= joined[e.parent] if h.requires else not left[e.parent]:
                steps.append(Step("hook", e.parent, hooks=(h,)))
                waiting[e.parent].remove(h)
    stuck = [f"{n} requires {', '.join(h.requires)}" for n, hs in waiting.items() for h in hs if h.requires]
    if stuck:
        raise ValueError("never joined: " + "; ".join(stuck))
    unreached = [l.table for l in graph.labels if not any(s.action == "label" and l in s.labels for s in steps)]
    if unreached:
        raise ValueError(f"no label can be made of {', '.join(unreached)}: it is not below the target")
    return Plan(graph, tuple(steps))


class _Run:
    def __init__(self, plan: Plan, spark: SparkSession, given: Mapping[str, DataFrame]) -> None:
        self.plan, self.graph, self.spark, self.given = plan, plan.graph, spark, given
        self.frames: dict[str, Frame] = {}
        self.reduced: dict[Edge, tuple[DataFrame, dict[str, Origin], str]] = {}

    def result(self) -> DataFrame:
        for s in self.plan.steps:
            getattr(self, "_" + s.action.replace(" ", "_"))(s)
        return self.frames[self.graph.target].df

    def _apply(self, df: DataFrame, hooks: tuple) -> DataFrame:
        ops: list[Op] = []
        for h in (*hooks, None):
            if isinstance(h, Op):
                ops.append(h)
                continue
            if ops:
                df, ops = compile_ops(df, ops), []
            if isinstance(h, Hook):
                df = h.fn(df) if h.fn else compile_ops(df, h.ops)
                if h.store:
                    df = h.store.cut(df, h.name)
                elif h.checkpoint:
                    df = checkpoint(df)
            elif h is not None:
                df = h(df)
        return df

    def _load(self, s: Step) -> None:
        t = self.graph.table(s.table)
        df = load(self.spark, t, self.given.get(t.name))
        for hooks in (t.annotate, t.filter, t.normalize):
            df = self._apply(df, hooks)
        if t.name == self.graph.target and self.graph.target_filter and t.time:
            kind = df.schema[f"{t.prefix}_{t.time}"].dataType
            df = df.filter(temporal.event_time(f"{t.prefix}_{t.time}", kind) < temporal.moment(self.graph.window_of(t).cut, kind))
        self.frames[t.name] = Frame(df, self._origins(t, df), df)

    def _origins(self, t: Table, df: DataFrame) -> dict[str, Origin]:
        declared = {t.key, *(e.child_key for e in self.graph.parents(t.name)), *(e.parent_key for e in self.graph.children(t.name))}
        out = {}
        for f in df.schema:
            bare = f.name.removeprefix(t.prefix + "_")
            kind = semantic_type(f.dataType)
            if kind not in ("timestamp", "opaque") and is_identifier(bare, declared):
                kind = "identifier"
            elif bare in t.binary_columns:
                kind = "numerical"
            out[f.name] = Origin(kind)
        return out

    def _name(self, table: str, key: str) -> str:
        return f"{self.graph.table(table).prefix}_{key}"

    def _front(self, s: Step) -> None:
        e, child, parent = s.edge, self.frames[s.edge.child], self.frames[s.edge.parent]
        df, key = parent.df, self._name(e.parent, e.parent_key)
        p = self.graph.table(e.parent)
        if self.graph.target_filter and p.time:
            kind = df.schema[f"{p.prefix}_{p.time}"].dataType
            df = df.filter(temporal.event_time(f"{p.prefix}_{p.time}", kind) < temporal.moment(self.graph.window_of(p).cut, kind))
        if self.graph.check_unique:
            df = require_unique(df, key)
        child.df = left_join(child.df, df, self._name(e.child, e.child_key), key, keep_key=True)
        child.origins |= parent.origins
        child.joined |= {e.parent} | parent.joined

    def _time(self, t: Table, df: DataFrame) -> tuple[str, T.DataType] | None:
        name = f"{t.prefix}_{t.time}"
        return (name, df.schema[name].dataType) if t.time and name in df.columns else None

    def _in_window(self, t: Table, e: Edge, df: DataFrame) -> DataFrame:
        at, w = self._time(t, df), self.graph.window_of(t)
        return df.filter(temporal.in_features(*at, w.cut, w.back, w.null_time)) if at and e.windowed else df

    def _is_series(self, t: Table, df: DataFrame, key: str) -> bool:
        if t.time_series != "auto":
            return bool(t.time_series)
        n, keys = df.agg(F.count("*"), F.count_distinct(f"`{key}`")).first()
        return bool(n) and keys / n < 0.9

    def _reduce(self, s: Step) -> None:
        e, t, policy = s.edge, self.graph.table(s.table), self.graph.policy
        frame, key, pk = self.frames[t.name], self._name(t.name, e.child_key), self._name(t.name, t.key)
        df, at, w = frame.df, self._time(t, frame.df), self.graph.window_of(t)
        origins = dict(frame.origins)
        series = policy.enabled and at is not None and self._is_series(t, df, key)
        df = self._in_window(t, e, df)
        if series and policy.gaps:
            gap = f"{t.prefix}_time_between_records"
            df = temporal.with_gaps(df, frame.df, *at, key, gap, w.back, w.cut, e.windowed, (pk,) if pk in df.columns else ())
            origins[gap] = Origin("numerical")
        custom: list[Column] = []
        for r in t.reduce:
            custom += aggregates([r]) if isinstance(r, Op) else [r()]
        own = df.groupBy(F.col(f"`{key}`")).agg(*custom).schema.fields[1:] if custom else []
        made = {f.name: Origin(semantic_type(f.dataType), "sum") for f in own}
        aggs = list(custom)
        if policy.enabled:
            auto, auto_made = auto_aggregates({n: o for n, o in origins.items() if n in df.columns}, {key}, policy, pk if pk in df.columns else None)
            parts = [(auto, auto_made)]
            if series:
                days = w.back.total_seconds() / 86400
                parts.append(time_features(t.prefix, *at, w.cut, days, policy))
            for columns, names in parts:
                for c, (n, o) in zip(columns, names.items()):
                    if n not in made:  # the user's own wins
                        aggs.append(c)
                        made[n] = o
        labels, label_made = label_aggregates({n: o for n, o in origins.items() if n in df.columns}, policy)
        aggs, made = [*aggs, *labels], made | label_made
        if not aggs:
            raise ValueError(f"nothing is aggregated of {t.name}: give it aggregates, or switch automatic features on")
        if policy.max_columns and len(aggs) > policy.max_columns:
            raise ValueError(f"{len(aggs)} features of {t.name}, more than {policy.max_columns}")
        self.reduced[e] = (df.groupBy(F.col(f"`{key}`")).agg(*aggs), made, key)

    def _join(self, s: Step) -> None:
        e, parent, t = s.edge, self.frames[s.edge.parent], self.graph.table(s.edge.child)
        if e.reduce:
            df, origins, key = self.reduced[e]
        else:
            frame, key = self.frames[t.name], self._name(t.name, e.child_key)
            df, origins = self._in_window(t, e, frame.df), {n: o for n, o in frame.origins.items() if n != key}
        parent.df = left_join(parent.df, df, self._name(e.parent, e.parent_key), key)
        parent.origins |= origins
        parent.joined |= {t.name} | self.frames[t.name].joined

    def _label(self, s: Step) -> None:
        e, t = s.edge, self.graph.table(s.edge.child)
        parent, rows, w = self.frames[s.edge.parent], self.frames[t.name].base, self.graph.window_of(t)
        at, key = self._time(t, rows), self._name(t.name, e.child_key)
        if at and e.windowed:
            rows = rows.filter(temporal.in_label(*at, w.cut, w.ahead))
        for df, specs in label_frames(rows, key, t.prefix, s.labels, self.graph.policy):
            parent.df = left_join(parent.df, df, self._name(e.parent, e.parent_key), key)
            for spec, new in specs:
                if spec.fill is not None:
                    parent.df = parent.df.fillna(spec.fill, new)
                parent.origins |= {c: Origin(semantic_type(df.schema[c].dataType), None, True, spec.propagate) for c in new}

    def _reduce_after_join(self, s: Step) -> None:
        t, frame = self.graph.table(s.table), self.frames[s.table]
        if not t.after_join_reduce:
            raise ValueError(f"{t.name} is to be reduced after the join, but has no after_join_reduce")
        frame.df = compile_ops(frame.df, t.after_join_reduce)
        frame.origins = {f.name: frame.origins.get(f.name, Origin(semantic_type(f.dataType), "sum")) for f in frame.df.schema}

    def _hook(self, s: Step) -> None:
        frame = self.frames[s.table]
        frame.df = self._apply(frame.df, s.hooks)
        frame.origins = {f.name: frame.origins.get(f.name, Origin(semantic_type(f.dataType))) for f in frame.df.schema}
