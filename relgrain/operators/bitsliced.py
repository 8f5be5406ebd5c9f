"""One row per entity with count, recency and total for each of hundreds of event types.

Counts and totals are kept as bit-sliced counters: for each type, bit k of all entities' numbers is one bitmap over the
entities' ordinals, and two counters are added by carrying from bitmap to bitmap, for all entities at once. Events
become such counters in tasks of equal size, the counters (their bitmaps compressed) are brought together by block, and
the latest times travel as arrays aligned to the ordinals of the entities that have the type.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, shuffle_partitions

_NEVER = np.iinfo(np.int64).min
#: Entities times types that a block decodes at once, at five numbers each: 160 MB.
_CELLS = 4_000_000


def bitmap(positions: np.ndarray, size: int) -> int:
    """The bitmap, as one whole number, with the bits at ``positions`` set."""
    bits = np.zeros(size, np.uint8)
    bits[positions] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def positions(bits: int, size: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((size + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little", count=size))


def slices(at: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    """For each bit of the numbers, the positions at which it is set."""
    top = int(numbers.max()).bit_length() if len(numbers) else 0
    return [at[(numbers >> k) & 1 == 1] for k in range(top)]


def carry_add(a: list[int], b: list[int]) -> list[int]:
    """The sum of two bit-sliced counters: a ripple-carry adder over whole bitmaps."""
    out, carry = [], 0
    for k in range(max(len(a), len(b))):
        x, y = (a[k] if k < len(a) else 0), (b[k] if k < len(b) else 0)
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (carry & half)
    return [*out, carry] if carry else out


def numbers(planes: list[int], size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    for k, plane in enumerate(planes):
        if plane:
            total[positions(plane, size)] += np.int64(1) << np.int64(k)
    return total


def _position(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _pack(at: np.ndarray, size: int) -> bytes:
    """A compressed bitmap: the positions where few bits are set, else the bits."""
    position = _position(size)
    if position().itemsize * len(at) < size // 8:
        return b"p" + at.astype(position).tobytes()
    return b"b" + bitmap(at, size).to_bytes((size + 7) // 8, "little")


def _unpack(raw: bytes, size: int) -> np.ndarray:
    if raw[:1] == b"p":
        return np.frombuffer(raw, _position(size), offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), bitorder="little", count=size))


_PART = "block int, span int, ids binary, types binary, payload binary"


def _encode(entities: np.ndarray, types: np.ndarray, counts: np.ndarray, latest: np.ndarray, totals: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counters of one block, its ordinals being the places in the sorted array of its entities."""
    ids, ordinal = np.unique(entities, return_inverse=True)
    size, at = len(ids), np.lexsort((ordinal, types))
    types, ordinal, counts, latest, totals = types[at], ordinal[at], counts[at], latest[at], totals[at]
    starts = np.flatnonzero(np.concatenate([[True], types[1:] != types[:-1]]))
    out = bytearray()
    for s, e in zip(starts, [*starts[1:], len(types)]):
        here = ordinal[s:e]
        maps = [_pack(here, size)]
        for values in (counts[s:e], totals[s:e]):
            planes = slices(here, values)
            maps += [bytes([len(planes)]), *(_pack(p, size) for p in planes)]
        maps.append(latest[s:e].tobytes())
        for m in maps:
            out += len(m).to_bytes(4, "little") + m
    return ids.astype(np.int64).tobytes(), types[starts].astype(np.int64).tobytes(), zlib.compress(bytes(out), 1)


def _decode(payload: bytes, n_types: int, size: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    raw, p = zlib.decompress(payload), 0

    def take() -> bytes:
        nonlocal p
        n = int.from_bytes(raw[p : p + 4], "little")
        p += 4 + n
        return raw[p - n : p]

    for _ in range(n_types):
        here = _unpack(take(), size)
        sets = [[_unpack(take(), size) for _ in range(take()[0])] for _ in range(2)]
        yield here, sets[0], sets[1], np.frombuffer(take(), np.int64)


def _presum(block: np.ndarray, entity: np.ndarray, kind: np.ndarray, n: np.ndarray, at: np.ndarray, total: np.ndarray):
    """Events of one entity and type within a batch become one, so that positions are distinct when bits are set."""
    order = np.lexsort((entity, kind, block))
    block, entity, kind, n, at, total = (x[order] for x in (block, entity, kind, n, at, total))
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]) | (entity[1:] != entity[:-1])])
    s = np.flatnonzero(new)
    return block[s], entity[s], kind[s], np.add.reduceat(n, s), np.maximum.reduceat(at, s), np.add.reduceat(total, s)


def _partials(rows: int, starts: np.ndarray):
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            block, entity, kind, n, at, total = _presum(*(t.column(c).to_numpy() for c in ("block", "entity", "type", "n", "at", "total")))
            if min(n.min(), total.min()) < 0:
                raise ValueError("events have a negative number or total")
            span = np.searchsorted(starts, kind, side="right")  # ascending with the types of a block
            cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (span[1:] != span[:-1])]))
            out = [(int(block[s]), int(span[s]), *_encode(entity[s:e], kind[s:e], n[s:e], at[s:e], total[s:e])) for s, e in zip(cuts, [*cuts[1:], len(block)])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t_) for c, t_ in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "span", "ids", "types", "payload"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield flush()
        if held:
            yield flush()

    return build


_NUMBERS, _ARRAYS = ("n_events", "n_types"), ("types", "counts", "recency_s", "totals")


def _features(cut_us: int, entity: str):
    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("axis").combine_chunks()
        axis = np.sort(lists.flatten().to_numpy())  # of the one row that has it
        ids = np.sort(left.column("entity").drop_null().to_numpy())
        span = left.column("span")[0].as_py() if left.num_rows else 0
        size = len(ids)
        counts: dict[int, list[int]] = {}
        totals: dict[int, list[int]] = {}
        latest = np.full((len(axis), size), _NEVER)
        for batch in right.to_batches():
            for local, kinds, payload in zip(*(batch.column(c).to_pylist() for c in ("ids", "types", "payload"))):
                there, kinds = np.frombuffer(local, np.int64), np.frombuffer(kinds, np.int64)
                to = np.searchsorted(ids, there)  # from the part's ordinals to the block's
                own = (to < size) & (ids[np.minimum(to, size - 1)] == there) if size else np.zeros(len(there), bool)
                places = np.searchsorted(axis, kinds)
                if (places == len(axis)).any() or (axis[places] != kinds).any():
                    raise ValueError("events have a type that the table of types lacks")
                for row, (here, c, t, last) in zip(places.tolist(), _decode(payload, len(kinds), len(there))):
                    counts[row] = carry_add(counts.get(row, []), [bitmap(to[x[own[x]]], size) for x in c])
                    totals[row] = carry_add(totals.get(row, []), [bitmap(to[x[own[x]]], size) for x in t])
                    last, here = last[own[here]], here[own[here]]
                    latest[row, to[here]] = np.maximum(latest[row, to[here]], last)
        n, total = np.zeros((2, size, len(axis)), np.int64)
        for row, planes in counts.items():
            n[:, row], total[:, row] = numbers(planes, size), numbers(totals[row], size)
        seen = latest.T != _NEVER
        recency = np.where(seen, (cut_us - np.where(seen, latest.T, 0)) // 1_000_000, 0)
        offsets = pa.array(np.arange(0, size * len(axis) + 1, len(axis)), pa.int32())
        listed = lambda a, none=None: pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a).ravel(), pa.int64(), mask=none))
        return pa.Table.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(np.full(size, span), pa.int32()),
                pa.array(n.sum(axis=1), pa.int64()),
                pa.array((n > 0).sum(axis=1), pa.int64()),
                listed(np.broadcast_to(axis, (size, len(axis)))),
                listed(n),
                listed(recency, ~np.ascontiguousarray(seen).ravel()),
                listed(total),
            ],
            [entity, "span", *_NUMBERS, *_ARRAYS],
        )

    return merge


def entity_features(
    events: DataFrame, entities: DataFrame, types: DataFrame, entity: str, cut_us: int, per_block: int = 2048, max_types: int = 20_000, batch_rows: int = 200_000, undated: bool = False
) -> DataFrame:
    """One row per entity: ``n_events, n_types`` and, aligned to ``types``, the arrays ``counts, recency_s, totals``.

    ``events``: entity (bigint), type (bigint), n, at (microseconds), total, each a bigint; n and total not negative,
    which is checked.
    They may be combined already, n being how many events a row stands for. Events at or after the cut, or without
    time, entity or type, are not features and are left out. ``entities`` and ``types`` have the ids that get a row and
    a place on the axis; events of an entity that ``entities`` lacks are left out, those of a type that ``types`` lacks
    are an error. A type that an entity never had has count 0,
    total 0 and no recency. ``recency_s`` is whole seconds from the latest event to the cut. With ``undated`` events without
    time are features too: they count and add their total, and give no recency.

    Types are cut into spans of about ``max_types`` neighbours, one span where there are no more; a task holds one
    block of entities and one span, and an entity's spans are put together at the end, so there may be any number of
    types. The driver gets one number for each further span. Entities are put in blocks of about ``per_block``, fewer
    if there are many types, by a hash of their id, and get their ordinal in the block's sorted ids. Events are first put in
    ranges of blocks, so that a task makes few and dense counters however many blocks there are; ranges are of equal
    size whatever the blocks, since within a block they go on by a hash of the event. An entity with any share of the
    events is spread over tasks, and costs each of them one position in each bitmap of its types. Entities and types are
    counted as this function is called.
    """
    spark = events.sparkSession
    if undated:
        events = events.withColumn("at", F.coalesce("at", F.lit(int(_NEVER))))
    events = events.filter(F.col("entity").isNotNull() & F.col("type").isNotNull() & (F.col("at") < cut_us))
    entities = entities.select(F.col(entity).cast("bigint").alias("entity")).filter("entity is not null").distinct()
    known = types.select(F.col(types.columns[0]).cast("bigint").alias("type")).filter("type is not null").distinct()
    known = checkpoint(known)  # a row a type; all events may have been read for it
    n_types = known.count()
    spans = max(1, -(-n_types // max_types))
    starts = sorted(set(known.agg(F.percentile_approx("type", [k / spans for k in range(1, spans)], 100_000)).first()[0])) if spans > 1 else []
    per_block = max(1, min(per_block, _CELLS // max(1, -(-n_types // spans))))
    n_blocks = max(1, -(-entities.count() // per_block))
    block = F.pmod(F.xxhash64("entity"), F.lit(n_blocks)).cast("int").alias("block")
    columns = ["entity", "type", "n", "at", "total"]
    near = events.select(block, *columns, F.xxhash64(*columns).alias("spread")).repartitionByRange(shuffle_partitions(spark), "block", "spread")
    parts = near.select("block", *columns).mapInArrow(_partials(batch_rows, np.array(starts, np.int64)), _PART)
    # Each task gets the ids of its block and the types of its span, which are a small part of what it gives.
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ids = entities.select("entity", block, upto(len(starts) + 1).alias("span"), F.lit(None).cast("array<bigint>").alias("axis"))
    span = F.size(F.filter(F.lit(starts).cast("array<bigint>"), lambda s: s <= F.col("type"))) if starts else F.lit(0)
    axes = known.groupBy(span.alias("span")).agg(F.collect_list("type").alias("axis")).select(F.lit(None).cast("bigint").alias("entity"), upto(n_blocks).alias("block"), "span", "axis")
    schema = f"`{entity}` bigint, span int, n_events bigint, n_types bigint, types array<bigint>, counts array<bigint>, recency_s array<bigint>, totals array<bigint>"
    out = ids.unionByName(axes).groupBy("block", "span").cogroup(parts.groupBy("block", "span")).applyInArrow(_features(cut_us, entity), schema)
    if not starts:
        return out.drop("span")
    whole = out.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("span", *_NUMBERS, *_ARRAYS))).alias("spans"))
    each = lambda c: F.transform("spans", lambda s: s[c])
    total = lambda c: F.aggregate(each(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return whole.select(entity, *[total(c).alias(c) for c in _NUMBERS], *[F.flatten(each(c)).alias(c) for c in _ARRAYS])
