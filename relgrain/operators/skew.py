"""Results per key where a few keys hold most rows: exact offset chunking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, looked_up, shuffle_partitions
from .exact import number_kind

_LOW = (1 << 32) - 1
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_COUNTS = ("n", "nv", "nord")


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; the first is True. Null equals null."""
    if len(column) < 2:
        return np.ones(len(column), bool)
    a, b = column[1:], column[:-1]
    nulls = pc.xor(pc.is_null(a), pc.is_null(b))
    differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), nulls)
    return np.concatenate([[True], differs.to_numpy(zero_copy_only=False)])


def _key_changes(columns: Sequence[pa.Array]) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new |= _changes(c)
    return new


class _States:
    """States of runs of rows as columns, and how neighbours become one.

    A state has counts of rows, values and orders, the sum, least and greatest value, the first and last order and the
    longest step between orders. Whole numbers are summed in two halves of 32 bits, decimals as decimals of 38 digits
    and floating numbers as such.
    """

    def __init__(self, kind: str, value_type: pa.DataType | None) -> None:
        self.kind = kind
        self.sum_type = pa.decimal128(38, value_type.scale) if kind == "decimal" else pa.float64()
        self.value_type = {"whole": pa.int64(), "floating": pa.float64()}.get(kind, value_type)
        self.values = ("hi", "lo") if kind == "whole" else ("vsum",)

    def schema(self) -> list[tuple[str, pa.DataType]]:
        sums = [(c, pa.int64() if self.kind == "whole" else self.sum_type) for c in self.values]
        return [*((c, pa.int64()) for c in _COUNTS), *sums, ("vmin", self.value_type), ("vmax", self.value_type), ("omin", pa.int64()), ("omax", pa.int64()), ("gap", pa.int64())]

    def of_rows(self, o: pa.Array, v: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """Each row as a state of its own."""
        has_o, has_v = (pc.is_valid(x).to_numpy(zero_copy_only=False) for x in (o, v))
        ov = pc.fill_null(o, 0).to_numpy(zero_copy_only=False)
        out = {"n": np.ones(len(o), np.int64), "nv": has_v.astype(np.int64), "nord": has_o.astype(np.int64)}
        if self.kind == "decimal":
            out |= {"vsum": v.cast(self.sum_type), "vmin": v, "vmax": v}
        elif self.kind == "whole":
            vv = pc.fill_null(v, 0).to_numpy(zero_copy_only=False)
            out |= {"hi": vv >> 32, "lo": vv & _LOW, "vmin": np.where(has_v, vv, _MOST), "vmax": np.where(has_v, vv, _LEAST)}
        else:
            vv = pc.fill_null(v.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            out |= {"vsum": vv, "vmin": np.where(has_v, vv, np.nan), "vmax": np.where(has_v, vv, -np.inf)}
        return out | {"omin": np.where(has_o, ov, _MOST), "omax": np.where(has_o, ov, _LEAST), "gap": np.full(len(o), -1)}

    def merge(self, s: dict, cuts: np.ndarray) -> dict:
        """One state for the states from each cut to the next, which are in order. Null orders come first in a key."""
        size = len(s["n"])
        inner = np.ones(size, bool)
        inner[cuts] = False
        both = inner[1:] & (s["nord"][1:] > 0) & (s["nord"][:-1] > 0)
        gap = s["gap"].copy()
        gap[1:] = np.maximum(gap[1:], np.where(both, np.where(both, s["omin"][1:], 0) - np.where(both, s["omax"][:-1], 0), -1))
        out = {c: np.add.reduceat(s[c], cuts) for c in _COUNTS}
        if self.kind == "decimal":
            place = np.zeros(size, np.int64)
            place[cuts] = 1
            t = pa.table({"place": np.cumsum(place), "vsum": s["vsum"], "vmin": s["vmin"], "vmax": s["vmax"]})
            t = t.group_by("place", use_threads=False).aggregate([("vsum", "sum"), ("vmin", "min"), ("vmax", "max")]).sort_by("place")
            about = np.add.reduceat(pc.fill_null(s["vsum"].cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), cuts)
            if (np.abs(about) >= 10.0 ** (38 - self.sum_type.scale)).any():
                raise OverflowError("a sum of decimals has more than 38 digits")
            out |= {c: t.column(f"{c}_{f}").combine_chunks().cast(k) for c, f, k in (("vsum", "sum", self.sum_type), ("vmin", "min", self.value_type), ("vmax", "max", self.value_type))}
        else:
            out |= {c: np.add.reduceat(s[c], cuts) for c in self.values}
            # Of floating numbers NaN is the greatest, as elsewhere in Spark.
            out |= {"vmin": (np.minimum if self.kind == "whole" else np.fmin).reduceat(s["vmin"], cuts), "vmax": np.maximum.reduceat(s["vmax"], cuts)}
        return out | {"omin": np.minimum.reduceat(s["omin"], cuts), "omax": np.maximum.reduceat(s["omax"], cuts), "gap": np.maximum.reduceat(gap, cuts)}

    @staticmethod
    def join(a: dict | None, b: dict) -> dict:
        if a is None:
            return b
        return {c: pa.concat_arrays([a[c], x]) if isinstance(x, pa.Array) else np.concatenate([a[c], x]) for c, x in b.items()}

    def arrow(self, s: dict) -> list[pa.Array]:
        none = {"vmin": s["nv"] == 0, "vmax": s["nv"] == 0, "omin": s["nord"] == 0, "omax": s["nord"] == 0, "gap": s["gap"] < 0}
        return [s[c] if isinstance(s[c], pa.Array) else pa.array(s[c], t, mask=none.get(c)) for c, t in self.schema()]

    def back(self, batch: pa.RecordBatch) -> dict:
        fills = {"vmin": _MOST if self.kind == "whole" else np.nan, "vmax": _LEAST if self.kind == "whole" else -np.inf, "omin": _MOST, "omax": _LEAST, "gap": -1}
        out = {}
        for c, _ in self.schema():
            x = batch.column(batch.schema.get_field_index(c))
            keep = self.kind == "decimal" and c in ("vsum", "vmin", "vmax")
            out[c] = x if keep else (pc.fill_null(x, fills[c]) if c in fills else x).to_numpy(zero_copy_only=False)
        return out


def _slice(s: dict, a: int, b: int | None) -> dict:
    return {c: x[a:b] for c, x in s.items()}


def _chunks(keys: list[str], states: _States, offsets: dict[int, int], chunk_rows: int):
    """Rows of a partition, in order, to one state for each chunk of each key: the last state stays open until its end is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_keys, held_chunk, number, pid, seq = None, None, None, 0, 0, 0

        def out(s: dict, columns: list[pa.Array], chunk: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            m = len(chunk)
            own = [pa.array(np.full(m, pid), pa.int32()), pa.array(np.arange(seq, seq + m)), pa.array(chunk, pa.int64())]
            seq += m
            return pa.RecordBatch.from_arrays([*columns, *own, *states.arrow(s)], [*keys, "pid", "seq", "chunk", *(c for c, _ in states.schema())])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            pid = batch.column(batch.schema.get_field_index("__pid"))[0].as_py()
            first = held is None
            columns = columns if first else [pa.concat_arrays([h, c]) for h, c in zip(held_keys, columns)]
            new = _key_changes(columns)
            s = states.join(held, states.of_rows(*(batch.column(batch.schema.get_field_index(n)) for n in ("__o", "__v"))))
            # Numbers of the rows within their key: the first key goes on from its offset or from the batch before.
            head = 0 if first else 1
            rows_new = new[head:].copy()
            goes_on = first or not rows_new[0]
            starts = np.flatnonzero(rows_new) if rows_new[0] else np.concatenate([[0], np.flatnonzero(rows_new)])
            at = np.arange(batch.num_rows)
            no = at - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            if goes_on:
                no[: starts[1] if len(starts) > 1 else batch.num_rows] += offsets.get(pid, 0) if first else number
            chunk = no // chunk_rows if first else np.concatenate([held_chunk, no // chunk_rows])
            number = int(no[-1]) + 1
            cut = new
            cut[1:] |= chunk[1:] != chunk[:-1]
            cuts = np.flatnonzero(cut)
            folded, firsts = states.merge(s, cuts), [c.take(pa.array(cuts)) for c in columns]
            last = len(cuts) - 1
            if last:
                yield out(_slice(folded, 0, last), [c[:last] for c in firsts], chunk[cuts][:last])
            held, held_keys, held_chunk = _slice(folded, last, None), [c[last:] for c in firsts], chunk[cuts][last:]
        if held is not None:
            yield out(held, held_keys, held_chunk)

    return run


def _per_partition(keys: list[str], states: _States):
    """States of a partition, in order, to one state for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_keys, pid = None, None, 0

        def out(s: dict, columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), pid), pa.int32()), *states.arrow(s)], [*keys, "pid", *(c for c, _ in states.schema())])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            pid = batch.column(batch.schema.get_field_index("pid"))[0].as_py()
            columns = columns if held is None else [pa.concat_arrays([h, c]) for h, c in zip(held_keys, columns)]
            cuts = np.flatnonzero(_key_changes(columns))
            folded, firsts = states.merge(states.join(held, states.back(batch)), cuts), [c.take(pa.array(cuts)) for c in columns]
            last = len(cuts) - 1
            if last:
                yield out(_slice(folded, 0, last), [c[:last] for c in firsts])
            held, held_keys = _slice(folded, last, None), [c[last:] for c in firsts]
        if held is not None:
            yield out(held, held_keys)

    return run


def _folded(df: DataFrame, keys: Sequence[str], order: str | None, value: str | None, chunk_rows: int, partitions: int | None, whole: bool) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    parts = partitions or shuffle_partitions(spark)
    keys, types = list(keys), dict(df.dtypes)
    kind, scale = number_kind(df, value) if value else ("whole", 0)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if types[c].startswith(("timestamp", "date")) else F.col(c).cast("bigint")
    if order and not types[order].startswith(("timestamp", "date")) and number_kind(df, order)[0] != "whole":
        raise TypeError(f"{order} is {types[order]}: rows are ordered by a time or a whole number")
    taken = F.lit(None).cast("bigint") if not value else F.col(value).cast({"whole": "bigint", "floating": "double"}.get(kind, types[value]))
    rows = df.select(*keys, (us(order) if order else F.lit(None).cast("bigint")).alias("__o"), taken.alias("__v"), F.monotonically_increasing_id().alias("__tie"))
    by = [*keys, "__o", "__tie"]
    ranged = checkpoint(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__tie").withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid", *keys).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = {r[0]: r[1] for r in counts.withColumn("before", before).filter("before > 0").select("__pid", "before").collect()}  # at most one a partition
    digits = int(types[value].split("(")[1].split(",")[0]) if kind == "decimal" else 0
    states = _States(kind, pa.decimal128(digits, scale) if kind == "decimal" else None)
    chunked = _chunks(keys, states, offsets, chunk_rows)
    merged = _per_partition(keys, states)
    sql = lambda t: f"decimal({t.precision},{t.scale})" if pa.types.is_decimal(t) else {pa.int64(): "bigint", pa.float64(): "double"}[t]
    own = ["pid int"] if whole else ["pid int", "seq bigint", "chunk bigint"]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *own, *(f"{c} {sql(t)}" for c, t in states.schema())])
    return ranged.mapInArrow((lambda batches: merged(chunked(batches))) if whole else chunked, schema), kind


def chunk_states(
    df: DataFrame, keys: Sequence[str], order: str | None = None, value: str | None = None, chunk_rows: int = 100_000, partitions: int | None = None
) -> DataFrame:
    """States of equal-sized chunks of each key's rows: ``keys, pid, seq, chunk, n`` and what can be merged in order.

    1. Rows are put in order of key, ``order`` and arrival. Arrival is unique, so a key of any size, even one of equal
       rows only, is cut anywhere: input partitions are equal whatever the keys. They are written as a checkpoint,
       since the next two steps must see the same partitions, also after the loss of an executor.
    2. Keys are counted per input partition, and prefix sums over the partitions give how many rows of a key lie before
       each. As partitions are in order, only a partition's first key can have such an offset: one number a partition
       goes to the driver. Steps 1 and 2 run as this function is called.
    3. Each partition numbers its rows within their key, from the offset, and folds every ``chunk_rows`` of a key into
       one state, with the first and last ``order``, so that states can be merged across borders. A state stays open
       from one batch of rows to the next, so a key of n rows has at most n / ``chunk_rows`` states, rounded up, and
       one more for each partition.
    """
    return _folded(df, keys, order, value, chunk_rows, partitions, whole=False)[0]


def per_key_results(
    df: DataFrame, keys: Sequence[str], order: str | None = None, value: str | None = None, chunk_rows: int = 100_000, partitions: int | None = None
) -> DataFrame:
    """Per key: ``n, n_value, sum_value, min_value, max_value, first_order, last_order, max_gap, chunks``.

    Exact and complete, whatever share of the rows a key has. ``value`` is a whole number, a decimal or a floating
    number, whose sum is a ``decimal(38,0)``, a decimal of 38 digits of the same scale (more is an error) or a double;
    any other type is an error. NaN is the greatest value. ``order`` is a time (microseconds come out) or a whole
    number; ``max_gap`` is the longest step between rows next to each other in that order, ties giving 0, and null for
    fewer than two. Null values and orders are left out of what is made of them; rows with a null key are a key of
    their own. Extra columns don't matter; a result named like a key gets a ``_``. An empty table gives no rows.

    Ordered states are merged in two steps: those of a partition where they are made, then, by key, at most one for
    each partition that has the key.
    """
    own = [f"__k{i}" for i in range(len(keys))]  # keys may be named like results
    named = df.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)], *([F.col(f"`{order}`").alias("__order")] if order else []), *([F.col(f"`{value}`").alias("__value")] if value else []))
    states, kind = _folded(named, own, order and "__order", value and "__value", chunk_rows, partitions, whole=True)
    # omax is ascending over a key's states, so the last one before is the largest before.
    earlier = Window.partitionBy(*own).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("gap", F.greatest("gap", F.col("omin") - F.max("omax").over(earlier)))
    total = F.sum("vsum")
    if kind == "whole":
        total = (F.sum(F.col("hi").cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(11,0)") + F.sum(F.col("lo").cast("decimal(20,0)"))).cast("decimal(38,0)")
    out = states.groupBy(*own).agg(
        F.sum("n").alias("n"),
        F.sum("nv").alias("n_value"),
        F.when(F.sum("nv") > 0, total).alias("sum_value"),
        F.min("vmin").alias("min_value"),
        F.max("vmax").alias("max_value"),
        F.min("omin").alias("first_order"),
        F.max("omax").alias("last_order"),
        F.max("gap").alias("max_gap"),
        F.expr(f"(sum(n) + {chunk_rows - 1}) div {chunk_rows}").alias("chunks"),
    )
    return out.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], *[F.col(c).alias(f"{c}_" if c in keys else c) for c in out.columns if c not in own])


def heavy_keys(df: DataFrame, group: str, key: str, share: float, chunk_rows: int = 100_000) -> DataFrame:
    """Keys that are not null and hold at least ``share`` of their group's rows, rows with a null key counted.

    Rows without a group belong to none. The groups' totals are counted from the group column alone and looked up by
    ``session.looked_up``: broadcast if the groups are few, joined with a salt else.
    """
    per_key = per_key_results(df.select(group, key), [group, key], chunk_rows=chunk_rows)
    totals = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("total"))
    joined = looked_up(per_key, totals, group, spread=key)
    return joined.filter(F.col(key).isNotNull() & (F.col("n") >= F.col("total") * F.lit(Decimal(str(share))))).select(group, key, "n", "total")
