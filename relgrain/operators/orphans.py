"""References to records that do not exist, from signed counts maintained per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .sieve import sieve, sifted

#: Columns of a state; ``changes`` has when the count of existence went up and down, in order.
STATE = ("table_name", "key", "refs", "rows", "first_ref", "last_ref", "undated_ref", "exists", "changes")


@dataclass(frozen=True)
class Reference:
    """Child records that name a parent. ``children``: row_id, key, at, gone; ``parents``: key, at, gone.

    One row a record; for ``orphan_rows`` children may come in copies (``copies``), of which the earliest stands.
    """

    table: str
    children: DataFrame
    parents: DataFrame
    copies: bool = False


def _log(df: DataFrame, refs: bool) -> DataFrame:
    sign = F.explode(F.array(F.struct(F.lit(1).cast("bigint").alias("d"), F.col("at").alias("at")), F.struct(F.lit(-1).cast("bigint").alias("d"), F.col("gone").alias("at"))))
    log = df.filter(F.col("key").isNotNull()).select("key", "gone", sign.alias("x")).filter((F.col("x.d") > 0) | F.col("gone").isNotNull())
    zero = F.lit(0).cast("bigint")
    return log.select("key", F.col("x.at").alias("at"), (F.col("x.d") if refs else zero).alias("d_refs"), (zero if refs else F.col("x.d")).alias("d_exists"))


def change_deltas(references: Sequence[Reference]) -> DataFrame:
    """The log of changes: ``table_name, key, at, d_refs, d_exists``, +1 where a record arrives and -1 where it goes."""
    parts = [_log(df, refs).select(F.lit(r.table).alias("table_name"), "*") for r in references for df, refs in ((r.children, True), (r.parents, False))]
    return reduce(DataFrame.unionByName, parts)


def _counts_of_refs(deltas: DataFrame) -> DataFrame:
    """Deltas as one-row states of references: what is summed, or the extreme of, when states are combined."""
    came = F.col("d_refs") > 0
    at = F.when(came, F.col("at"))
    return deltas.filter("d_refs <> 0").withColumns({"refs": F.col("d_refs"), "rows": F.when(came, F.col("d_refs")).otherwise(0), "first_ref": at, "last_ref": at, "undated_ref": came & F.col("at").isNull()})


def _combine_refs(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("refs").alias("refs"), F.sum("rows").alias("rows"), F.min("first_ref").alias("first_ref"), F.max("last_ref").alias("last_ref"), F.max("undated_ref").alias("undated_ref"))


def _combine_existence(rows: DataFrame, by: list[str]) -> DataFrame:
    change = F.struct(F.col("at").alias("at"), F.col("d_exists").alias("d"))
    return rows.groupBy(*by).agg(F.sum("d_exists").alias("exists"), F.sort_array(F.collect_list(change)).alias("changes"))


def _joined(refs: DataFrame, existence: DataFrame, by: list[str]) -> DataFrame:
    both = refs.join(existence, by, "full")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("refs", "rows", "exists")}
    none = F.array().cast(dict(existence.dtypes)["changes"])
    return both.withColumns(zero | {"undated_ref": F.coalesce("undated_ref", F.lit(False)), "changes": F.coalesce("changes", none)})


def apply_deltas(deltas: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after more changes: signed counts of references and of existence per table and key.

    ``state`` is what an earlier call gave, from a table or checkpoint of one's own; without it the counts begin at
    nothing. Deltas may come in any batches and any order: the counts are sums, and the rest of a state (first and last
    reference, changes of existence by time) does not depend on the order either.

    References are combined before the shuffle, so a key that any share of the rows refers to is a row per map task.
    A key's changes of existence, a few for a record that is created and deleted, are held in its row.
    """
    by = ["table_name", "key"]
    refs, births = _counts_of_refs(deltas).select(*by, "refs", "rows", "first_ref", "last_ref", "undated_ref"), deltas.filter("d_exists <> 0").select(*by, "at", "d_exists")
    if state is not None:
        refs = refs.unionByName(state.filter("rows > 0 or refs <> 0").select(*refs.columns))
        kept = state.select(*by, F.explode("changes").alias("x"))
        births = births.unionByName(kept.select(*by, F.col("x.at").alias("at"), F.col("x.d").alias("d_exists")))
    return _joined(_combine_refs(refs, by), _combine_existence(births, by), by).select(*STATE)


def _times(changes: Column, up: bool) -> Column:
    return F.filter(changes, lambda x: x["d"] > 0 if up else x["d"] < 0)


def exists_at(changes: Column, at: Column) -> Column:
    """The signed count of existence as of a time, changes at that time included; the final one where it is null."""
    upto = F.filter(changes, lambda x: at.isNull() | x["at"].isNull() | (x["at"] <= at))
    return F.aggregate(upto, F.lit(0).cast("bigint"), lambda n, x: n + x["d"])


def orphans_of_state(state: DataFrame) -> DataFrame:
    """``table_name, key, refs, exists, kind``: keys that are referred to now and don't exist now: positive references,
    no existence. The kind is ``missing`` if there never was such a record, else ``deleted``."""
    now = state.filter((F.col("refs") > 0) & (F.col("exists") <= 0))
    return now.select("table_name", "key", "refs", "exists", F.when(F.size(_times(F.col("changes"), True)) > 0, "deleted").otherwise("missing").alias("kind"))


def current_orphans(references: Sequence[Reference]) -> DataFrame:
    """``orphans_of_state`` of the references' whole history."""
    return orphans_of_state(apply_deltas(change_deltas(references)))


def orphan_rows(references: Sequence[Reference], hot_share: float = 1 / 256) -> DataFrame:
    """``table_name, row_id, at, kind`` of the child records whose key's count of existence was not positive when they
    arrived.

    kind is ``missing`` if the count never went up, ``late`` if it had not gone up by then (the parent arrived after
    the child), else ``deleted`` (it had gone down again, before or as the child arrived). A child whose arrival time
    is null is held against the final count; a parent whose arrival time is null was always there. Records without a
    key refer to nothing.

    From the signed counts come the doubtful keys: those whose count can have been zero at a reference. Only the
    records of those are shuffled: keys with at least ``hot_share`` of a table's references, of which there are at
    most ``1 / hot_share`` a table, are broadcast; of the others a sieve of bounded size is, and what passes it is
    joined by key. The few rows of hot keys that go the same way are spread by a salt that matches nothing, so no key
    gathers in one task. Copies of a child record are counted as references of their own, which changes no sign, and
    become one row at the end, of the doubtful keys only. The doubtful keys are written as a checkpoint as this
    function is called, since hot keys, sieve and join each need them.
    """
    doubtful = checkpoint(reduce(DataFrame.unionByName, [_doubtful(r).withColumn("place", F.lit(i)) for i, r in enumerate(references)]))
    sizes = reduce(DataFrame.unionByName, [r.children.agg(F.lit(i).alias("place"), F.count("*").alias("n")) for i, r in enumerate(references)])
    least = {place: max(1, int(n * hot_share)) for place, n in sizes.collect()}  # a number a reference
    parts = [_orphans_of(r, doubtful.filter(F.col("place") == i), least[i]) for i, r in enumerate(references)]
    return reduce(DataFrame.unionByName, parts)


def _doubtful(r: Reference) -> DataFrame:
    """Keys of the state at which the count of existence can have been zero when some reference came."""
    # By key alone, so that parents that are partitioned by it already are not shuffled again.
    refs = _combine_refs(_counts_of_refs(_log(r.children, True)), ["key"])
    state = _joined(refs, _combine_existence(_log(r.parents, False).filter("d_exists <> 0"), ["key"]), ["key"]).filter("rows > 0")
    ups, downs = _times(F.col("changes"), True), _times(F.col("changes"), False)
    born, died = F.get(ups, F.lit(0))["at"], F.get(downs, F.lit(0))["at"]
    doubtful = (F.size(ups) == 0) | (born.isNotNull() & (F.col("undated_ref") | (F.col("first_ref") < born))) | ((F.size(downs) > 0) & (F.col("undated_ref") | died.isNull() | (F.col("last_ref") >= died)))
    return state.filter(F.coalesce(doubtful, F.lit(True))).select("key", "rows", "changes")


def _orphans_of(r: Reference, state: DataFrame, least: int) -> DataFrame:
    hot = F.broadcast(state.filter(F.col("rows") >= least).select("key", F.col("changes").alias("hot")))
    cold = state.filter(F.col("rows") < least).select("key", F.col("changes").alias("cold"), F.lit(0).alias("salt"))
    children = r.children.filter(F.col("key").isNotNull()).select("row_id", "key", "at").join(hot, "key", "left")
    near = sifted(children, sieve(cold, "key"), "key", always=F.col("hot").isNotNull())
    near = near.withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("row_id"), F.lit(1 << 20))).cast("int"))
    found = near.join(cold, ["key", "salt"], "left").withColumn("changes", F.coalesce("hot", "cold")).filter(F.col("changes").isNotNull())
    if r.copies:
        # Copies agree but for when they arrived; rows without an id can't be told to be copies.
        alone = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id())
        earliest = found.groupBy("row_id", alone.alias("alone")).agg(F.min("at").alias("at"), F.any_value("changes").alias("changes"))
        found = earliest.drop("alone")
    at, changes = F.col("at"), F.col("changes")
    came = F.filter(changes, lambda x: (x["d"] > 0) & (at.isNull() | x["at"].isNull() | (x["at"] <= at)))
    kind = F.when(F.size(_times(changes, True)) == 0, "missing").when(exists_at(changes, at) > 0, F.lit(None)).when(F.size(came) == 0, "late").otherwise("deleted")
    return found.select(F.lit(r.table).alias("table_name"), "row_id", "at", kind.alias("kind")).filter(F.col("kind").isNotNull())
