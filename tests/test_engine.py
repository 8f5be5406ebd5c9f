"""The feature engine: specs, plans, results by hand, leakage, plans' shapes, sources, stores, streams and the command line."""

import json
import os
import random
import warnings
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from compare import spark_bag
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgrain import cli
from relgrain.functions.period import period
from relgrain.functions.semantic import is_identifier, semantic_type
from relgrain.functions.temporal import clean_times, in_features, with_gaps
from relgrain.operators.join import left_join, require_unique, where_exists, with_existence
from relgrain.operators.ops import compile_ops
from relgrain.plans import Edge, EntityGraph, FeaturePolicy, Hook, LabelSpec, Op, Source, Table, Window, plan
from relgrain.session import as_view, release, work_folder
from relgrain.sources.readers import files_view, load, pick, read, sample
from relgrain.sources.store import Store, replace_table
from relgrain.streaming.lookbacks import streaming_counts

CUT = datetime(2023, 6, 30)
WINDOW = Window(CUT, (365, "day"), (90, "day"))
ORDERS = [
    (1, 1, datetime(2023, 5, 12), 10), (2, 1, datetime(2023, 6, 1), 12), (3, 1, datetime(2023, 9, 2), 1200), (4, 2, datetime(2023, 1, 1), 13), (5, 2, datetime(2022, 8, 5), 150),
    (6, 2, CUT, 999), (7, 3, datetime(2023, 6, 1), 220), (8, 3, CUT + timedelta(days=90), 220), (9, 3, datetime(2023, 7, 1), 5), (10, 4, datetime(2020, 1, 1), 7), (11, 4, None, 3), (12, 9, datetime(2023, 6, 1), 1),
]
LINES = [(i, 1 + i % 12, 100 + i % 5) for i in range(24)]


@pytest.fixture
def frames(spark):
    return {
        "cust": spark.createDataFrame([(i, f"name {i}") for i in (1, 2, 3, 4)], "id int, name string"),
        "orders": spark.createDataFrame(ORDERS, "id int, customer_id int, ts timestamp_ntz, amount int"),
        "lines": spark.createDataFrame(LINES, "id int, order_id int, product_id int"),
    }


NONE = Source(table="given")
CUST = Table("cust", NONE, "c", "id")
ORD = Table("orders", NONE, "o", "id", "ts")
LIN = Table("lines", NONE, "l", "id")
CO, OL = Edge("cust", "orders", "id", "customer_id"), Edge("orders", "lines", "id", "order_id")


def graph(**more):
    return EntityGraph(**({"tables": (CUST, ORD, LIN), "edges": (CO, OL), "target": "cust", "window": WINDOW, "policy": FeaturePolicy(lookbacks=(30, 90, 365))} | more))


def by_id(df):
    return {r["c_id"]: r for r in df.collect()}


def test_features_by_hand(spark, frames):
    got = by_id(plan(graph()).run(spark, frames))
    assert {i: got[i]["o_amount_sum"] for i in got} == {1: 22, 2: 163, 3: 220, 4: 3}  # a null time stays, the cut and before the window not
    assert (got[1]["o_amount_median"], got[2]["o_amount_mean"], got[2]["o_amount_min"], got[2]["o_amount_max"]) == (11.0, 81.5, 13, 150)
    assert (got[1]["o_num_events_30d"], got[1]["o_num_events_90d"], got[2]["o_num_events_90d"], got[1]["o_30dv90_change"]) == (1, 2, 0, 0.5)
    assert got[4]["o_30dv90_change"] is None and got[1]["o_seconds_since_last"] == 29 * 86400
    assert "o_customer_id_count" not in got[1] and got[1]["o_id_count"] == 2
    assert got[1]["l_id_count_sum"] == sum(x[1] in (1, 2) for x in LINES)
    dropped = by_id(plan(graph(window=replace(WINDOW, null_time="drop"))).run(spark, frames))
    assert dropped[4]["o_amount_sum"] is None


@pytest.mark.parametrize(("op", "expected"), [("count", {1: 1, 3: 1}), ("sum", {1: 1200, 3: 5}), ("bool", {1: 1, 3: 1}), (lambda c: F.max(c) * 2, {1: 2400, 3: 10})])
def test_labels(spark, frames, op, expected):
    df = plan(graph(labels=(LabelSpec("orders", op, "amount"),))).run(spark, frames)
    assert {i: r["o_amount_label"] for i, r in by_id(df).items() if r["o_amount_label"] is not None} == expected
    filled = plan(graph(labels=(LabelSpec("orders", op, "amount", fill=0),))).run(spark, frames)
    assert by_id(filled)[2]["o_amount_label"] == 0 and filled.count() == 4


def test_labels_leak_nothing(spark, frames):
    """What happens after the cut doesn't change features; what happened before doesn't change labels."""
    g = graph(labels=(LabelSpec("orders", "sum", "amount"),), window=replace(WINDOW, null_time="drop"), policy=FeaturePolicy(gaps=True))
    base, r = by_id(plan(g).run(spark, frames)), random.Random(1)
    late = [(i, c, t, a if t is None or t < CUT else r.randrange(10**6)) for i, c, t, a in ORDERS] + [(100 + i, 1, CUT + timedelta(days=r.randrange(400)), 5) for i in range(20)]
    early = [(i, c, t, a if t is not None and t > CUT else r.randrange(10**6)) for i, c, t, a in ORDERS] + [(100 + i, 1, CUT - timedelta(days=r.randrange(400)), 5) for i in range(20)]
    after, before = (by_id(plan(g).run(spark, frames | {"orders": spark.createDataFrame(x, frames["orders"].schema)})) for x in (late, early))
    for i in base:
        own = {c: v for c, v in base[i].asDict().items() if not c.endswith("_label")}
        assert {c: after[i][c] for c in own} == own
        assert before[i]["o_amount_label"] == base[i]["o_amount_label"]


def test_grain_order_and_determinism(spark, frames):
    a = plan(graph()).run(spark, frames)
    other = EntityGraph((LIN, ORD, CUST), (OL, CO), "cust", WINDOW, FeaturePolicy(lookbacks=(30, 90, 365)))
    b = plan(other).run(spark, {k: v.repartition(3) for k, v in frames.items()})
    assert a.count() == 4 and spark_bag(a) == spark_bag(b)


def test_empty_tables_and_extra_columns(spark, frames):
    empty = {k: v.limit(0) for k, v in frames.items()}
    assert plan(graph()).run(spark, empty).count() == 0
    got = plan(graph()).run(spark, empty | {"cust": frames["cust"]})
    assert got.count() == 4 and got.filter("o_amount_sum is not null").count() == 0
    wide = frames | {"orders": frames["orders"].withColumns({"__k": F.lit(1), "c_id": F.lit(2), "name": F.lit("x")})}
    assert by_id(plan(graph()).run(spark, wide))[1]["o_amount_sum"] == 22


def test_planning_runs_no_job(spark, frames):
    spark.sparkContext.setJobGroup("planning", "planning")
    p = plan(graph(labels=(LabelSpec("orders", "count", "id"),)))
    p.explain(), p.mermaid(), p.html()
    predicted = p.columns(spark, {k: v.schema for k, v in frames.items()})
    df = p.run(spark, frames)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")
    assert [(f.name, f.dataType) for f in predicted] == [(f.name, f.dataType) for f in df.schema]


def test_one_exchange_a_reduction(spark, frames, tmp_path):
    for k, v in frames.items():
        v.write.parquet(str(tmp_path / k))
    stored = {k: spark.read.parquet(str(tmp_path / k)) for k in frames}
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        policy = FeaturePolicy(functions={"numerical": ("sum", "max"), "identifier": ("count",)})
        text = plan(graph(policy=policy, labels=(LabelSpec("orders", "count", "id"),))).run(spark, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert text.count("Exchange hashpartitioning") <= 5 and "Python" not in text
    assert "LessThan(ts,2023-06-30" in text and "GreaterThan(ts,2023-06-30" in text  # both windows reach the scan


def test_diamonds_warn_and_aliases_join(spark, frames):
    both = (CO, Edge("cust", "lines", "id", "product_id"), OL)
    with pytest.warns(UserWarning, match="alias"):
        plan(graph(edges=both))
    again = LIN.alias("m", "again")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        df = plan(graph(tables=(CUST, ORD, LIN, again), edges=(CO, OL, Edge("cust", "again", "id", "product_id")))).run(spark, frames | {"again": frames["lines"]})
    assert {"m_id_count", "l_id_count_sum"} <= set(df.columns)


def test_child_grain_hooks_and_reduce_after_join(spark, frames):
    rows = plan(graph(tables=(CUST, ORD), edges=(replace(CO, reduce=False, windowed=False),))).run(spark, frames)
    assert rows.count() == 11
    c = replace(CUST, after_join_reduce=(Op("key", "c_id"), Op("agg", "count(o_id) as n")))
    df = plan(graph(tables=(c, ORD), edges=(replace(CO, reduce=False, reduce_after_join=True),))).run(spark, frames)
    assert {r["c_id"]: r["n"] for r in df.collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    seen = []
    hook = Hook(fn=lambda d: (seen.append(1), d.withColumn("twice", F.col("o_amount_sum") * 2))[1], requires=("orders",))
    df = plan(graph(tables=(replace(CUST, after_join=(hook,)), ORD, LIN))).run(spark, frames)
    assert len(seen) == 1 and by_id(df)[1]["twice"] == 44
    with pytest.raises(ValueError, match="never joined"):
        plan(graph(tables=(replace(CUST, after_join=(Hook(fn=lambda d: d, requires=("lines",)),)), ORD, LIN), edges=(CO,)))


def test_front_join(spark, frames):
    g = EntityGraph((CUST, ORD), (CO,), "orders", WINDOW, front_hops=1, check_unique=True)
    assert plan(g).run(spark, frames).filter("c_name is not null").count() == 11
    with pytest.raises(Exception, match="not unique"):
        plan(g).run(spark, frames | {"cust": frames["cust"].union(frames["cust"])}).collect()
    assert g.levels_up("orders") == [["cust"]] and require_unique(frames["cust"], "id").count() == 4


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda: graph(tables=(CUST, replace(ORD, prefix="c"), LIN)), "prefix"),
        (lambda: graph(target="nobody"), "no such table"),
        (lambda: graph(window=Window(CUT), labels=(LabelSpec("orders", "count", "id"),)), "horizon"),
        (lambda: replace(CO, reduce_after_join=True), "not both"),
        (lambda: Op("where", "where a = 1"), "without"),
        (lambda: Op("limit", "3"), "unknown kind"),
        (lambda: period(1, "fortnight"), "unknown unit"),
        (lambda: LabelSpec("orders", "mode", "id"), "unknown label"),
        (lambda: LabelSpec("orders", "sum"), "needs a field"),
        (lambda: Source(), "exactly one"),
        (lambda: Hook(), "function or ops"),
        (lambda: plan(graph(edges=(CO,), labels=(LabelSpec("lines", "count", "id"),))), "not below"),
    ],
)
def test_mistakes_are_told_at_once(make, message):
    with pytest.raises(ValueError, match=message):
        make()


def test_mistakes_told_when_columns_are_known(spark, frames):
    with pytest.raises(ValueError, match="no column"):
        load(spark, replace(ORD, time="when"), frames["orders"])
    with pytest.raises(ValueError, match="nothing is aggregated"):
        plan(graph(policy=FeaturePolicy(enabled=False))).run(spark, frames)
    with pytest.raises(ValueError, match="more than 3"):
        plan(graph(policy=FeaturePolicy(max_columns=3))).run(spark, frames)
    with pytest.raises(ValueError, match="both sides"):
        left_join(frames["cust"], frames["orders"], "id", "customer_id")
    with pytest.raises(TypeError):
        EntityGraph((CUST,), (), "cust", WINDOW, unknown=1)


def test_auto_time_series_text_and_date_times(spark, frames):
    for kind in ("date", "string"):
        orders = frames["orders"].filter("id <> 6 and id <> 8").withColumn("ts", F.col("ts").cast(kind))
        got = by_id(plan(graph(tables=(CUST, replace(ORD, time_series="auto"), LIN))).run(spark, frames | {"orders": orders}))
        assert got[1]["o_amount_sum"] == 22 and got[1]["o_num_events_30d"] == 1
    once = frames["orders"].dropDuplicates(["customer_id"])
    assert "o_num_events_30d" not in plan(graph(tables=(CUST, replace(ORD, time_series="auto"), LIN))).run(spark, frames | {"orders": once}).columns


def test_semantics():
    assert [semantic_type(t) for t in (T.BooleanType(), T.DecimalType(5, 2), T.DateType(), T.StringType(), T.ArrayType(T.FloatType()), T.ArrayType(T.StringType()), T.ArrayType(T.LongType()), T.MapType(T.StringType(), T.StringType()))] == [
        "boolean", "numerical", "timestamp", "categorical", "embedding", "multicategorical", "sequence_numerical", "opaque",
    ]
    assert [is_identifier(n) for n in ("id", "user_id", "custkey", "uuid", "amount", "paid_at", "name")] == [True, True, True, True, False, False, False]
    assert period(1, "month") == timedelta(minutes=30.417 * 1440) and period(2, "year") == timedelta(days=730)


def test_ops(spark, frames):
    o = frames["orders"]
    assert compile_ops(o, (Op("select", "*, amount * 2 as amount"),)).filter("id = 1").first()["amount"] == 20
    assert compile_ops(o, (Op("select", "id, concat('a, b', '(') as t"),)).columns == ["id", "t"]
    ordered = compile_ops(o, (Op("where", "ts is not null"), Op("order", "amount desc nulls last, id"), Op("select", "id"))).collect()
    assert [r[0] for r in ordered][:2] == [3, 6]
    with pytest.raises(ValueError, match="alone"):
        compile_ops(o, (Op("custom", "select 1"), Op("where", "true")))
    with pytest.raises(ValueError, match="aggregate"):
        compile_ops(o, (Op("key", "id"),))


def test_sources_and_stores(spark, frames, tmp_path):
    o = frames["orders"].filter("ts is not null")
    for kind in ("parquet", "csv", "tsv", "json", "orc"):
        store = Store(str(tmp_path / kind), "local", kind)
        if kind in ("csv", "tsv", "json"):
            back = store.cut(o.withColumn("ts", F.col("ts").cast("string")), "orders")
        else:
            back = store.cut(o, "orders")
        assert back.count() == 11 and back.columns and set(back.columns) == set(o.columns)
        got = read(spark, Source(path=store.path("orders"), format=kind))
        assert got.count() == 11
    assert Store("bucket/x", "s3").path("a") == "s3a://bucket/x/a" and Store("s3a://b").path("a") == "s3a://b/a"
    with pytest.raises(ValueError, match="provider"):
        Store("x", "moon").path("a")
    o.createOrReplaceTempView("some_orders")
    assert read(spark, Source(table="some_orders")).count() == 11 and read(spark, Source(fn=lambda s: s.range(3))).count() == 3
    replace_table(spark.range(3).toDF("a"), "kept")
    assert replace_table(spark.range(4).toDF("a"), "kept").count() == 4
    (tmp_path / "bad.csv").write_text("a,b\n1,2\nx,3\n", encoding="utf-8")
    assert len(read(spark, Source(path=str(tmp_path / "bad.csv"), format="csv", schema="a int, b int", options={"mode": "DROPMALFORMED"})).collect()) == 1
    assert pick(["Id", "NAME"], ["user", "name"]) == "NAME" and pick(["a"], ["b"], required=False) is None and sample(o, 3).count() == 3
    with pytest.raises(ValueError, match="none of"):
        pick(["a"], ["b"])
    times = spark.createDataFrame([("2024-01-01",), ("x",), (None,), ("2024-01-02 03:04:05",)], "t string")
    kept, removed = clean_times(times, "t")
    assert kept.count() == 2 and times.agg(removed).first()[0] == 50.0


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(i % 3, datetime(2024, 1, 1) + timedelta(hours=5 * i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, value long")
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    query = streaming_counts(stream, "user_id", "ts", value="value", late="60 days").writeStream.outputMode("update").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark_bag(spark.table("counted")) == spark_bag(streaming_counts(df, "user_id", "ts", value="value"))


def test_command_line(spark, frames, tmp_path, capsys):
    for k, v in frames.items():
        v.write.parquet(str(tmp_path / f"{k}.parquet"))
    edges = [{"parent": "cust.parquet", "child": "orders.parquet", "parent_key": "id", "child_key": "customer_id"}]
    args = [str(tmp_path), "--target", "cust.parquet", "--prefixes", json.dumps({"cust.parquet": "c", "orders.parquet": "o"}), "--keys", json.dumps({"cust.parquet": "id", "orders.parquet": "id"}),
            "--times", json.dumps({"orders.parquet": "ts"}), "--edges", json.dumps(edges), "--cut", "2023-06-30", "--label", json.dumps({"table": "orders.parquet", "op": "count", "field": "id", "days": 90})]
    cli.main(args)
    assert "reduce orders.parquet by customer_id" in capsys.readouterr().out
    cli.main([*args, "--output", str(tmp_path / "out")])
    got = by_id(spark.read.parquet(str(tmp_path / "out")))
    assert got[1]["o_amount_sum"] == 22 and got[3]["o_id_label"] == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test data are not here")
def test_approximate_aggregates_are_near_exact_ones(spark):
    from relgrain.queries import features

    got = {r["c_custkey"]: r for r in features.QUERIES["approx_values"](spark, "/root/testdata/sf0.001").collect()}
    own = features.run(
        spark, (features.customer("/root/testdata/sf0.001"), features.orders("/root/testdata/sf0.001", columns=("orderkey", "custkey", "totalprice", "orderpriority", "orderdate"), reduce=(Op("agg", "sort_array(collect_list(o_totalprice)) as o_prices"), Op("agg", "count(distinct o_orderpriority) as o_kinds"),))), (features.CO,),
    ).collect()
    assert len(got) == len(own) and any(r["o_prices"] for r in own)
    for r in own:
        x, prices = got[r["c_custkey"]], [float(p) for p in r["o_prices"] or []]
        if not prices:
            assert x["o_totalprice_median"] is None
            continue
        # percentile_approx gives one of the values, here the lower middle one; distinct counts are within 15 % (three standard errors).
        assert x["o_totalprice_median"] == pytest.approx(prices[(len(prices) - 1) // 2])
        assert abs(x["o_orderpriority_nunique"] - r["o_kinds"]) <= 0.15 * r["o_kinds"]


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("bounded", "pieces"), [(True, 64), (True, 3), (False, 7)])
def test_gaps_are_those_to_the_event_before(spark, bounded, pieces):
    """Over the whole history, across the window's begin and the pieces' borders, whatever share a key has."""
    r = random.Random(pieces)
    rows = [(i, r.choice([1] * 9 + [2, 3, None]), r.choice([None, *[datetime(2022, 1, 1) + timedelta(hours=r.randrange(16_000)) for _ in range(20)]])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz").repartition(5)
    kind, back = T.TimestampNTZType(), timedelta(days=200)
    inside = df.filter(in_features("ts", kind, CUT, back)) if bounded else df
    got = {x["id"]: x["gap"] for x in with_gaps(inside, df, "ts", kind, "k", "gap", back, CUT, bounded, ("id",), pieces).collect()}
    expected = {}
    for k in (1, 2, 3):
        before = None
        for i, _, t in sorted((x for x in rows if x[1] == k and x[2] is not None), key=lambda x: (x[2], x[0])):
            expected[i] = None if before is None else int((t - before).total_seconds())
            before = t
    kept = {i for i, _, t in rows if not bounded or t is None or CUT - back < t < CUT}
    assert set(got) == kept
    assert {i: g for i, g in got.items() if i in expected} == {i: g for i, g in expected.items() if i in kept}
    assert all(g is None for i, g in got.items() if rows[i][2] is None)


def test_gaps_read_only_the_window_row_by_row(spark, tmp_path, frames):
    frames["orders"].write.parquet(str(tmp_path / "orders"))
    o = Table("orders", Source(path=str(tmp_path / "orders")), "o", "id", "ts")
    g = replace(graph(policy=FeaturePolicy(gaps=True)), tables=(graph().tables[0], o, *graph().tables[2:]))
    text = plan(g).run(spark, {k: v for k, v in frames.items() if k != "orders"})._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in text.split("\n") if "FileScan parquet" in x]
    assert len(scans) == 2 and all("LessThan(ts" in x for x in scans) and sum("GreaterThan(ts" in x for x in scans) == 1


def test_existence_is_one_join(spark, frames):
    c, o = frames["cust"], frames["orders"]
    flagged = with_existence(c, o, "r.customer_id = l.id AND r.amount > l.id * 100", "big")
    assert {x["id"]: x["big"] for x in flagged.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert plan_text(flagged).count("Join ExistenceJoin") == 1 and plan_text(flagged).count("LogicalRDD") == 2
    some = where_exists(c, (o, "r.customer_id = l.id AND r.amount > 900"), (c, "r.id = l.id + 1 AND r.name = 'name 4'"))
    assert sorted(x["id"] for x in some.collect()) == [1, 2, 3] and with_existence(c, o.limit(0), "r.id = l.id", "x").filter("x").count() == 0


def test_labels_of_a_table_are_one_aggregation(spark, frames):
    labels = (LabelSpec("orders", "sum", "amount", fill=0), LabelSpec("orders", "count", "id"), LabelSpec("orders", (Op("agg", "max(case when o_amount > 100 then 1 else 0 end) as o_big_label"),), fill=0))
    df = plan(graph(labels=labels)).run(spark, frames)
    one = plan(graph(labels=labels[:1])).run(spark, frames)
    assert plan_text(df).count("Join LeftOuter") == plan_text(one).count("Join LeftOuter")
    got = by_id(df)
    assert (got[1]["o_amount_label"], got[1]["o_id_label"], got[1]["o_big_label"]) == (1200, 1, 1) and (got[3]["o_amount_label"], got[3]["o_big_label"]) == (5, 0)
    assert (got[4]["o_amount_label"], got[4]["o_id_label"], got[4]["o_big_label"]) == (0, None, 0)
    more = plan(graph(labels=(*labels, LabelSpec("orders", (Op("where", "o_amount > 100"), Op("agg", "count(*) as o_n_label")))))).run(spark, frames)
    assert by_id(more)[1]["o_n_label"] == 1 and by_id(more)[3]["o_n_label"] is None
    with pytest.raises(ValueError, match="two labels"):
        plan(graph(labels=(labels[0], LabelSpec("orders", "max", "amount")))).run(spark, frames)


def test_results_as_views_and_their_release(spark, frames, tmp_path):
    df = plan(graph()).run(spark, frames, view="features_of_customers")
    assert spark.sql("select count(*) from features_of_customers").first()[0] == df.count()
    folder = work_folder(spark)
    Store(folder).write(spark.range(3), "three")
    (tmp_path / "a.csv").write_text("a,b\n1,2\nx,3\n", encoding="utf-8")
    assert files_view(spark, "some_files", Source(path=str(tmp_path / "a.csv"), format="csv", schema="a int, b int", options={"mode": "DROPMALFORMED"})).count() == 1
    as_view(spark.range(2), "two")
    release(spark)
    assert not any(spark.catalog.tableExists(n) for n in ("features_of_customers", "some_files", "two"))
    with pytest.raises(Exception, match="(?i)path does not exist"):
        spark.read.parquet(f"{folder}/three")
    release(spark)


def test_hooks_keep_their_result_in_a_store(spark, frames, tmp_path):
    store = Store(str(tmp_path), "local")
    kept = Hook(fn=lambda df: df.withColumn("o_twice", F.col("o_amount") * 2), store=store, name="orders_hooked")
    tables = graph().tables
    df = plan(replace(graph(), tables=(tables[0], replace(tables[1], annotate=(kept,)), *tables[2:]))).run(spark, frames)
    assert store.read(spark, "orders_hooked").count() == len(ORDERS) and "o_twice_sum" in df.columns and "orders_hooked" in str(df.inputFiles())
    with pytest.raises(ValueError, match="under a name"):
        Hook(fn=lambda df: df, store=store)


def test_a_replaced_table_is_never_missing(spark, tmp_path):
    root = str(tmp_path)
    for n in range(1, 5):
        before = spark.table("swapped") if n > 1 else None
        assert replace_table(spark.range(n).toDF(f"a{n % 2}"), "swapped", root=root).count() == n
        if before is not None:
            assert before.count() == n - 1  # who reads the old version goes on reading it
    assert len(os.listdir(tmp_path / "swapped.versions")) == 2
    spark.range(1).write.saveAsTable("a_table")
    with pytest.raises(ValueError, match="is a table"):
        replace_table(spark.range(1), "a_table", root=root)
    spark.sql("drop view swapped")
    spark.sql("drop table a_table")


def test_the_page_shows_the_graph_and_escapes(spark, frames):
    g = graph()
    odd = replace(g, tables=(g.tables[0], replace(g.tables[1], name='or<d>"ers'), *g.tables[2:]), edges=tuple(replace(e, child=e.child.replace("orders", 'or<d>"ers'), parent=e.parent.replace("orders", 'or<d>"ers')) for e in g.edges))
    page = plan(odd).html()
    assert page.count("<rect") == len(g.tables) and page.count("<line") == len(g.edges) and "or<d>" not in page and "or&lt;d&gt;&quot;ers" in page
    assert '"or<d>"ers' not in plan(odd).mermaid() and "#quot;" in plan(odd).mermaid()
    assert [e.child for e in g.descendants("cust")][0] == "orders" and g.descendants("lines") == ()


def test_jdbc(spark):
    """Another database, here the one that comes with Spark's jars, within the JVM."""
    url = "jdbc:derby:memory:relgrain;create=true"
    jdbc = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark._jvm.java.lang.Class.forName(jdbc["driver"])
    except Exception:
        pytest.skip("no database in Spark's jars")
    spark.range(5).selectExpr("id", "id * 2 as twice").write.format("jdbc").options(**jdbc, dbtable="numbers").save()
    got = load(spark, Table("n", Source(path="", format="jdbc", options={**jdbc, "dbtable": "numbers"}), "n", "id"))
    assert sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(5)] and got.columns == ["n_id", "n_twice"]
