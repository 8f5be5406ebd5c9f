"""Query fragments compiled to one DataFrame."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..plans.spec import Op

_ALIAS = re.compile(r"(?is)\A(.*)\s+as\s+`?(\w+)`?\s*\Z")


def _items(text: str) -> list[str]:
    """The parts of a list at its own commas, not those in brackets or quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _select(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """A projection in which ``*`` together with an alias that exists replaces the column instead of repeating it."""
    items = [x for t in texts for x in _items(t)] or ["*"]
    named = {m.group(2).lower(): m.group(1) for m in map(_ALIAS.match, items) if m}
    if "*" not in items:
        return df.select(*[F.expr(x) for x in items])
    kept = [F.expr(named[c.lower()]).alias(c) if c.lower() in named else F.col(f"`{c}`") for c in df.columns]
    have = {c.lower() for c in df.columns}
    new = [F.expr(x) for x in items if x != "*" and not ((m := _ALIAS.match(x)) and m.group(2).lower() in have)]
    return df.select(*kept, *new)


def aggregates(ops: Sequence[Op]) -> list[Column]:
    return [F.expr(x) for o in ops if o.kind == "agg" for x in _items(o.expr)]


def compile_ops(df: DataFrame, ops: Sequence[Op]) -> DataFrame:
    """``where`` (all of them), then either ``key``, ``agg`` and ``having``, or ``window`` and ``select``; last ``order``.

    A ``custom`` op is a query of its own over ``{this}`` and stands alone.
    """
    of = {k: [o.expr for o in ops if o.kind == k] for k in ("select", "where", "key", "agg", "having", "order", "window", "custom")}
    if of["custom"]:
        if len(ops) > 1:
            raise ValueError("a custom op stands alone")
        return df.sparkSession.sql(of["custom"][0], this=df)
    for text in of["where"]:
        df = df.filter(F.expr(text))
    if of["agg"]:
        keys = [F.expr(x) for t in of["key"] for x in _items(t)]
        df = df.groupBy(*keys).agg(*aggregates(ops))
        if of["select"]:
            df = _select(df, of["select"])
    elif of["key"] or (of["having"] and not of["window"]):
        raise ValueError("a group query needs an aggregate")
    else:
        if of["window"]:
            df = _select(df, ["*", *of["window"]])
        df = _select(df, of["select"])
    for text in of["having"]:
        df = df.filter(F.expr(text))
    return df.orderBy(*[_order(x) for t in of["order"] for x in _items(t)]) if of["order"] else df


def _order(text: str) -> Column:
    m = re.match(r"(?is)\A(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*\Z", text)
    expr, way, nulls = F.expr(m.group(1)), (m.group(2) or "asc").lower(), (m.group(3) or "").lower()
    return getattr(expr, way + (f"_nulls_{nulls}" if nulls else ""))()
