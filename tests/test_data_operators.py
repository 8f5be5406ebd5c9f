"""Rolling totals, exact chunking, bit-sliced features and orphan references against brute force and at their edges."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relgrain.operators import bitsliced as b
from relgrain.operators.orphans import Reference, apply_deltas, current_orphans, orphan_rows, orphans_of_state
from relgrain.operators.rolling import rolling_totals
from relgrain.operators.sieve import sieve, sifted
from relgrain.operators.skew import chunk_states, heavy_keys, per_key_results
from relgrain.sources.records import records

# --- rolling ----------------------------------------------------------------------------------------------------------


def brute_rolling(rows, periods):
    by = defaultdict(list)
    for e, d, v in rows:
        if e is not None and d is not None:
            by[e].append((d, v))
    out = {}
    for e, xs in by.items():
        days = [d for d, _ in xs]
        for d in range(min(days), max(days) + 1):
            for p in periods:
                inside = [v for x, v in xs if d - p < x <= d]
                known = [v for v in inside if v is not None]
                out.setdefault((e, d), []).extend([len(inside), sum(known) if known else None, sum(known) / len(known) if known else None])
    return out


def test_rolling(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([r.randrange(0, 12), r.randrange(0, 200), None]), r.choice([None, 0, -5, 10**18, r.randrange(100)])) for _ in range(400)]
    rows += [(7, 5, 1)] * 3 + [(8, 0, None), (8, 100, None)]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "customer long, d int, amount long, day string, __e int")
    got = {(x["customer"], (x["day"] - date(1970, 1, 1)).days): x for x in rolling_totals(df, "customer", "d", "amount", (7, 30)).collect()}
    expected = brute_rolling(rows, (7, 30))
    assert got.keys() == expected.keys()
    for k, (n7, s7, a7, n30, s30, a30) in expected.items():
        g = got[k]
        assert (g["n_7d"], g["sum_7d"], g["n_30d"], g["sum_30d"]) == (n7, s7 if s7 is None else Decimal(s7), n30, s30 if s30 is None else Decimal(s30))
        assert g["avg_7d"] == (a7 if a7 is None else pytest.approx(a7)) and g["avg_30d"] == (a30 if a30 is None else pytest.approx(a30))
    assert rolling_totals(df.limit(0), "customer", "d", "amount").count() == 0


@pytest.mark.parametrize("kind", ["decimal(10,2)", "decimal(38,18)", "double", "decimal(5,5)"])
def test_rolling_keeps_fractions(spark, kind):
    rows = [(1, 0, "0.4"), (1, 0, "0.4"), (1, 0, "0.4"), (1, 8, "-0.25"), (1, 8, None), (2, 3, None)]
    df = spark.createDataFrame(rows, "e int, d int, v string").withColumn("v", F.col("v").cast(kind))
    got = {(x["e"], (x["day"] - date(1970, 1, 1)).days): x for x in rolling_totals(df, "e", "d", "v", (7, 30)).collect()}
    assert len(got) == 10 and float(got[1, 0]["sum_7d"]) == pytest.approx(1.2) and got[1, 0]["avg_7d"] == pytest.approx(0.4)
    assert got[1, 7]["sum_7d"] is None and float(got[1, 8]["sum_7d"]) == -0.25 and got[1, 8]["n_7d"] == 2
    assert float(got[1, 8]["sum_30d"]) == pytest.approx(0.95) and got[1, 8]["avg_30d"] == pytest.approx(0.2375) and got[2, 3]["sum_7d"] is None
    if kind.startswith("decimal"):
        assert got[1, 8]["sum_30d"] == Decimal("0.95")


def test_rolling_refuses_what_has_no_sum_and_calendars_without_end(spark):
    with pytest.raises(TypeError, match="v is string"):
        rolling_totals(spark.createDataFrame([(1, 1, "1")], "e int, d int, v string"), "e", "d", "v")
    stray = spark.createDataFrame([("ann", -719000, 1), ("ann", 19000, 1), ("bob", 1, 1)], "e string, d int, v int")
    with pytest.raises(Exception, match="entity ann has 738001 days"):
        rolling_totals(stray, "e", "d", "v").collect()
    assert rolling_totals(stray, "e", "d", "v", max_days=800_000).count() == 738_002


# --- exact chunking -----------------------------------------------------------------------------------------------------


def brute_keys(rows):
    by = defaultdict(list)
    for k, o, v in rows:
        by[k].append((o, v))
    out = {}
    for k, xs in by.items():
        o = sorted(x for x, _ in xs if x is not None)
        v = [x for _, x in xs if x is not None]
        gaps = [y - x for x, y in zip(o, o[1:])]
        out[k] = (len(xs), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), min(o, default=None), max(o, default=None), max(gaps, default=None))
    return out


@pytest.mark.parametrize(("chunk_rows", "partitions"), [(7, 5), (1, 3), (10_000, 1), (50, 8)])
def test_per_key_results(spark, chunk_rows, partitions):
    r = random.Random(chunk_rows)
    rows = [(r.choice(["hot"] * 6 + ["b", "c", None, ""]), r.choice([None, r.randrange(1000), 500]), r.choice([None, r.randrange(-(10**17), 10**17), 2**62])) for _ in range(700)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "n string, o long, v long, pid int").repartition(6)
    out = per_key_results(df, ["n"], "o", "v", chunk_rows, partitions)
    got = {x[0]: tuple(int(y) if isinstance(y, Decimal) else y for y in x[1:9]) for x in out.collect()}
    assert got == brute_keys(rows)


def test_chunks_are_equal_and_cut_any_key(spark):
    df = spark.createDataFrame([(1, 5)] * 1000, "k int, o int").repartition(3)
    states = chunk_states(df, ["k"], "o", None, 100, 4)
    by = states.groupBy("chunk").agg(F.sum("n").alias("n")).collect()
    assert sorted((x["chunk"], x["n"]) for x in by) == [(i, 100) for i in range(10)]
    per = [x[0] for x in states.groupBy("pid").agg(F.sum("n").alias("n")).select("n").collect()]
    assert len(per) == 4 and max(per) < 400  # equal rows only, and yet spread
    assert per_key_results(df.limit(0), ["k"], "o").count() == 0


def test_a_key_has_a_state_a_chunk_and_partition(spark):
    """Whatever the batches in which its rows come; and one a partition once they are merged."""
    df = spark.createDataFrame([(1, i) for i in range(3000)] + [(k, 0) for k in range(2, 50)], "k int, o int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        states = chunk_states(df, ["k"], "o", "o", 500, 4).collect()
        got = {x["k"]: x for x in per_key_results(df, ["k"], "o", "o", 500, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len([x for x in states if x["k"] == 1]) <= -(-3000 // 500) + 4 and sum(x["n"] for x in states) == 3048
    assert got[1]["n"] == 3000 and got[1]["chunks"] == 6 and got[1]["max_gap"] == 1 and got[1]["sum_value"] == 3000 * 2999 // 2


@pytest.mark.parametrize("kind", ["decimal(10,2)", "decimal(38,18)", "double"])
def test_per_key_results_keep_fractions(spark, kind):
    rows = [("a", "0.9"), ("a", "0.9"), ("b", None), ("a", "-1.5"), ("c", "2.25"), ("a", None)] * 5
    df = spark.createDataFrame(rows, "k string, v string").withColumn("v", F.col("v").cast(kind)).repartition(4)
    got = {x["k"]: x for x in per_key_results(df, ["k"], value="v", chunk_rows=4, partitions=3).collect()}
    assert float(got["a"]["sum_value"]) == pytest.approx(1.5) and float(got["a"]["min_value"]) == -1.5 and float(got["a"]["max_value"]) == pytest.approx(0.9)
    assert got["b"]["sum_value"] is None and got["b"]["min_value"] is None and got["b"]["n"] == 5 and float(got["c"]["sum_value"]) == 11.25
    assert kind == "double" or got["a"]["sum_value"] == Decimal("1.5")
    assert per_key_results(df.limit(0), ["k"], value="v").count() == 0


def test_per_key_results_refuse_what_has_no_sum(spark):
    df = spark.createDataFrame([("a", "1", 0.5, Decimal("9" * 37), float("nan")), ("a", "1", 0.5, Decimal("9" * 37), 1.0)] * 9, "k string, s string, f double, d decimal(38,0), x double")
    with pytest.raises(TypeError, match="is string"):
        per_key_results(df, ["k"], value="s")
    with pytest.raises(TypeError, match="a time or a whole number"):
        per_key_results(df, ["k"], order="f")
    with pytest.raises(Exception, match="more than 38 digits"):
        per_key_results(df, ["k"], value="d", partitions=1).collect()
    x = per_key_results(df, ["k"], value="x").first()
    assert x["min_value"] == 1.0 and x["max_value"] != x["max_value"]


def test_heavy_keys_fold_once(spark):
    plan = heavy_keys(spark.createDataFrame([("a", 1)] * 9, "t string, k int"), "t", "k", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_heavy_keys_count_null_keys(spark):
    rows = [("a", 1)] * 3 + [("a", None)] * 90 + [("a", 2)] * 7 + [("b", 2)] * 2
    got = heavy_keys(spark.createDataFrame(rows, "t string, k int"), "t", "k", 0.03).collect()
    assert sorted((x["t"], x["k"], x["n"], x["total"]) for x in got) == [("a", 1, 3, 100), ("a", 2, 7, 100), ("b", 2, 2, 2)]


# --- bit-sliced counters ------------------------------------------------------------------------------------------------

NUMBERS = st.lists(st.integers(0, 10**6), min_size=1, max_size=40)


@given(NUMBERS, NUMBERS)
def test_carry_add(x, y):
    n = max(len(x), len(y))
    x, y = (np.array(v + [0] * (n - len(v))) for v in (x, y))
    planes = [[b.bitmap(p, n) for p in b.slices(np.arange(n), v)] for v in (x, y)]
    assert (b.numbers(b.carry_add(*planes), n) == x + y).all()
    assert (b.numbers(b.carry_add(planes[0], []), n) == x).all()


@given(st.sets(st.integers(0, 999)))
def test_packed_bitmaps(at):
    at = np.array(sorted(at), np.int64)
    for size in (1000, 70_000, 2_000_000):
        far = at + size - 1000
        assert (b._unpack(b._pack(far, size), size) == far).all()


def test_entity_features(spark):
    r = random.Random(5)
    events = [(r.choice([1] * 8 + [2, 3, -7, 2**60, None]), r.choice([10, 10, 10, 20, 30, None]), r.randrange(1, 5), r.choice([r.randrange(1000), 5000, None]), r.randrange(0, 10**9)) for _ in range(600)]
    df = spark.createDataFrame(events, "entity long, type long, n long, at long, total long").repartition(7)
    who = spark.createDataFrame([(x,) for x in (1, 2, 3, -7, 2**60, 99, 99, None)], "customer_id long")
    types = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, None)], "id long")
    got = {x["customer_id"]: x for x in b.entity_features(df, who, types, "customer_id", 2_000_000, per_block=2, batch_rows=50).collect()}
    assert got == {}.fromkeys(got) or set(got) == {1, 2, 3, -7, 2**60, 99}
    for e, x in got.items():
        for t, n, rec, total in zip(x["types"], x["counts"], x["recency_s"], x["totals"]):
            own = [v for v in events if v[0] == e and v[1] == t and v[3] is not None and v[3] < 2_000_000]
            assert n == sum(v[2] for v in own) and total == sum(v[4] for v in own)
            assert rec == ((2_000_000 - max(v[3] for v in own)) // 1_000_000 if own else None)
        assert x["types"] == [10, 20, 30, 40] and x["n_events"] == sum(x["counts"]) and x["n_types"] == sum(n > 0 for n in x["counts"])
    assert b.entity_features(df.limit(0), who, types, "customer_id", 1).count() == 6
    assert b.entity_features(df, who.limit(0), types, "customer_id", 1).count() == 0
    some = {x["customer_id"]: x for x in b.entity_features(df, who.filter("customer_id in (2, 99)"), types, "customer_id", 2_000_000, per_block=2, batch_rows=50).collect()}
    assert some == {k: got[k] for k in (2, 99)}
    spanned = b.entity_features(df, who, types, "customer_id", 2_000_000, per_block=2, max_types=2, batch_rows=50)
    assert {x["customer_id"]: x for x in spanned.collect()} == got and spanned.columns == b.entity_features(df, who, types, "customer_id", 1).columns
    with pytest.raises(Exception, match="a type that the table of types lacks"):
        b.entity_features(df, who, types.filter("id < 20"), "customer_id", 2_000_000).collect()


def test_negative_totals_are_refused(spark):
    df = spark.createDataFrame([(1, 10, 1, 5, -7)], "entity long, type long, n long, at long, total long")
    who, types = spark.createDataFrame([(1,)], "customer_id long"), spark.createDataFrame([(10,)], "id long")
    with pytest.raises(Exception, match="a negative number or total"):
        b.entity_features(df, who, types, "customer_id", 9).collect()


def test_more_types_than_a_task_holds(spark):
    events = spark.range(60_000).selectExpr("id % 30 as entity", "(id * 7) % 25000 as type", "1L as n", "id as at", "2L as total").repartition(5)
    who, types = spark.range(31).withColumnRenamed("id", "customer_id"), spark.range(25_000)
    got = {x["customer_id"]: x for x in b.entity_features(events, who, types, "customer_id", 10**6).collect()}
    assert len(got) == 31 and all(x["types"] == list(range(25_000)) and len(x["counts"]) == 25_000 for x in got.values())
    expected = defaultdict(int)
    for i in range(60_000):
        expected[i % 30, i * 7 % 25_000] += 1
    assert {(e, t): n for e, x in got.items() for t, n in enumerate(x["counts"]) if n} == expected
    assert got[30]["n_events"] == 0 and all(x["totals"] == [2 * n for n in x["counts"]] and x["n_events"] == sum(x["counts"]) for x in got.values())


def test_blocks_of_many_entities(spark):
    """Positions beyond 16 bits: few of a block's entities have the type."""
    events = spark.createDataFrame([(e, 10, e % 5 + 1, 5, e) for e in range(7, 100_000, 9_999)] + [(e, 20, 1, 5, 0) for e in range(100_000)], "entity long, type long, n long, at long, total long").repartition(3)
    out = b.entity_features(events, spark.range(100_000).withColumnRenamed("id", "customer_id"), spark.createDataFrame([(10,), (20,)], "id long"), "customer_id", 10, per_block=200_000)
    got = {x["customer_id"]: (x["counts"], x["totals"]) for x in out.filter("counts[0] > 0 or counts[1] <> 1").collect()}
    assert got == {e: ([e % 5 + 1, 1], [e, 0]) for e in range(7, 100_000, 9_999)}


def test_entity_features_without_time(spark):
    df = spark.createDataFrame([(1, 10, 2, None, 7), (1, 10, 1, 4_000_000, 3), (1, 20, 5, None, 0), (1, 20, 1, 9_000_000, 1)], "entity long, type long, n long, at long, total long")
    who, types = spark.createDataFrame([(1,), (2,)], "customer_id long"), spark.createDataFrame([(10,), (20,)], "id long")
    got = {x["customer_id"]: x for x in b.entity_features(df, who, types, "customer_id", 9_000_000, undated=True).collect()}
    assert (got[1]["counts"], got[1]["recency_s"], got[1]["totals"], got[1]["n_events"], got[1]["n_types"]) == ([3, 5], [5, None], [10, 0], 8, 2)
    assert got[2]["counts"] == [0, 0] and got[2]["recency_s"] == [None, None]


# --- orphan references ----------------------------------------------------------------------------------------------------

T0 = datetime(2024, 1, 1)


def brute_orphans(children, parents):
    out = {}
    for row_id, key, at, _ in children:
        if key is None:
            continue
        p = [x for x in parents if x[0] == key]
        if not p:
            out[row_id] = "missing"
        elif p[0][1] is not None and at is not None and p[0][1] > at:
            out[row_id] = "late"
        elif p[0][2] is not None and (at is None or p[0][2] <= at):
            out[row_id] = "deleted"
    return out


@pytest.mark.parametrize("hot_share", [1 / 256, 0.2, 1.0])
def test_orphans(spark, hot_share):
    r = random.Random(11)
    when = lambda: r.choice([None, *[T0 + timedelta(days=r.randrange(6)) for _ in range(9)]])
    children = [(i, r.choice([1] * 10 + [2, 3, 4, 5, 6, None]), when(), r.choice([None, T0])) for i in range(500)]
    parents = [(k, when(), r.choice([None, T0 + timedelta(days=3), T0])) for k in (1, 2, 3, 4)]
    c = spark.createDataFrame(children, "row_id long, key long, at timestamp_ntz, gone timestamp_ntz").repartition(5)
    p = spark.createDataFrame(parents, "key long, at timestamp_ntz, gone timestamp_ntz")
    refs = [Reference("a", c, p), Reference("empty", c.limit(0), p), Reference("no_parents", c.filter("row_id < 9"), p.limit(0))]
    rows = orphan_rows(refs, hot_share).collect()
    assert {x["row_id"]: x["kind"] for x in rows if x["table_name"] == "a"} == brute_orphans(children, parents)
    assert {x["row_id"]: x["kind"] for x in rows if x["table_name"] == "no_parents"} == brute_orphans(children[:9], [])
    twice = [Reference("a", c.union(c.withColumn("at", F.col("at") + F.expr("INTERVAL 9 DAYS"))), p, copies=True)]
    assert {x["row_id"]: x["kind"] for x in orphan_rows(twice, hot_share).collect()} == brute_orphans(children, parents)
    now = {x["key"]: (x["refs"], x["kind"]) for x in current_orphans(refs).collect() if x["table_name"] == "a"}
    gone = {k for k, _, g in parents if g}
    left = {k: sum(x[1] == k and x[3] is None for x in children) for k in (1, 2, 3, 4, 5, 6)}
    assert now == {k: (n, "missing" if k > 4 else "deleted") for k, n in left.items() if n and (k > 4 or k in gone)}


def test_state_is_maintained_batch_by_batch(spark):
    """Deltas applied in batches give the state, and the orphans, of all applied at once; orphans come and go on the way."""
    r = random.Random(2)
    when = lambda: T0 + timedelta(days=r.randrange(30))
    deltas = []
    for _ in range(300):
        at = when()
        deltas.append(("a", r.choice([1] * 9 + list(range(2, 12))), at, 1, 0))
        if r.random() < 0.5:
            deltas.append(("a", deltas[-1][1], at + timedelta(days=r.randrange(9)), -1, 0))
    deltas += [("a", k, when(), 0, 1) for k in range(1, 9)] + [("a", k, T0 + timedelta(days=31), 0, -1) for k in (1, 2)] + [("a", 2, T0 + timedelta(days=33), 0, 1), ("a", 3, None, 0, -1)]
    schema = "table_name string, key long, at timestamp_ntz, d_refs long, d_exists long"
    whole = apply_deltas(spark.createDataFrame(deltas, schema))
    now = lambda s: {x["key"]: (x["refs"], x["kind"]) for x in orphans_of_state(s).collect()}
    for batches in ([deltas[i::5] for i in range(5)], [deltas, []], [sorted(deltas, key=lambda d: (d[2] is None, d[2] or T0))[i : i + 200] for i in range(0, 800, 200)]):
        state, done = None, []
        for b_ in batches:
            state, done = apply_deltas(spark.createDataFrame(b_, schema), state).checkpoint(), [*done, *b_]
            refs, there = defaultdict(int), defaultdict(int)
            for _, k, _, d, e in done:
                refs[k] += d
                there[k] += e
            born = {d[1] for d in done if d[4] > 0}
            assert now(state) == {k: (n, "deleted" if k in born else "missing") for k, n in refs.items() if n > 0 and there[k] <= 0}
        assert sorted(map(str, state.collect())) == sorted(map(str, whole.collect()))
    assert apply_deltas(spark.createDataFrame([], schema)).count() == 0


def test_counts_as_of_the_child(spark):
    """A record that is deleted and comes back: what counts is whether it was there when the child came."""
    day = lambda n: T0 + timedelta(days=n)
    p = spark.createDataFrame([(1, day(2), day(4)), (1, day(6), None), (2, day(3), day(1))], "key long, at timestamp_ntz, gone timestamp_ntz")
    c = spark.createDataFrame([(i, 1, day(i), None) for i in range(8)] + [(20 + i, 2, day(i), None) for i in range(5)], "row_id long, key long, at timestamp_ntz, gone timestamp_ntz")
    got = {x["row_id"]: x["kind"] for x in orphan_rows([Reference("t", c, p)]).collect()}
    assert got == {0: "late", 1: "late", 4: "deleted", 5: "deleted", 20: "late", 21: "late", 22: "late", 23: "deleted", 24: "deleted"}


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_sieve_lets_all_partners_pass(spark, words):
    keys = spark.range(0, 4000, 7).withColumnRenamed("id", "key").union(spark.sql("select cast(null as bigint)"))
    rows = spark.range(8000).withColumnRenamed("id", "key").union(spark.sql("select cast(null as bigint)"))
    s = sieve(keys, "key", words)
    assert s.count() <= words
    passed = {x[0] for x in sifted(rows, s, "key", words).collect()}
    assert set(range(0, 4000, 7)) <= passed and None not in passed and (words < 1 << 20 or len(passed) < 700)
    assert {x[0] for x in sifted(rows, s, "key", words, always=F.col("key").isNull() | (F.col("key") == 1)).collect()} >= {None, 1, 7}
    assert sifted(rows, sieve(keys.limit(0), "key"), "key").count() == 0


def test_records(spark):
    t = T0
    rows = [(1, "a", 5, t), (1, "a", 5, t - timedelta(days=1)), (2, None, None, t), (2, None, None, t), (None, "x", 1, t), (None, "x", 1, t)]
    df = spark.createDataFrame(rows, "id long, s string, v long, loaded_at timestamp_ntz")
    out = records(df, {"s": "s", "v": "v"}).collect()
    assert len(out) == 4 and [(x["s"], x["loaded_at"]) for x in out if x["id"] == 1] == [("a", t - timedelta(days=1))]
    assert records(df, {"s": "s"}, loaded=None).count() == 4 and records(df.limit(0), {}).count() == 0
