"""Queries of the feature engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import in_features, in_label
from ..operators.join import where_exists, with_existence
from ..operators.ops import compile_ops
from ..plans import Edge, EntityGraph, FeaturePolicy, Hook, LabelSpec, Op, Source, Table, Window, plan
from ..plans.spec import OFF
from ..session import checkpoint
from ..sources.readers import load
from ..streaming.lookbacks import streaming_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CUT = datetime(2000, 1, 1)
WINDOW = Window(CUT, (365, "day"), (90, "day"))
NO_TIME = FeaturePolicy(counts=False, ratios=False, recency=False)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def source(folder: str, name: str, strip: str = "") -> Source:
    def read(spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        return df.toDF(*[c.removeprefix(strip) for c in df.columns]) if strip else df

    return Source(fn=read)


def money(*names: str) -> Hook:
    return Hook(fn=lambda df: df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names}))


def customer(folder: str, **more) -> Table:
    return Table("customer", source(folder, "customer", "c_"), "c", "custkey", **({"columns": ("custkey",)} | more))


def orders(folder: str, **more) -> Table:
    return Table("orders", source(folder, "orders", "o_"), "o", "orderkey", "orderdate", **({"columns": ("orderkey", "custkey", "totalprice", "orderdate"), "annotate": (money("o_totalprice"),)} | more))


def lineitem(folder: str, **more) -> Table:
    columns = ("orderkey", "linenumber", "extendedprice", "shipdate")
    return Table("lineitem", source(folder, "lineitem", "l_"), "l", "linenumber", "shipdate", **({"columns": columns, "annotate": (money("l_extendedprice"),)} | more))


CO = Edge("customer", "orders", "custkey", "custkey")
OL = Edge("orders", "lineitem", "orderkey", "orderkey")


def run(spark: SparkSession, tables: tuple[Table, ...], edges: tuple[Edge, ...], target: str = "customer", window: Window = WINDOW, policy: FeaturePolicy = OFF, **more) -> DataFrame:
    return plan(EntityGraph(tables, edges, target, window, policy, **more)).run(spark)


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


IN = "o_orderdate > TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'"
AFTER = "o_orderdate > TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-03-31'"
PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"

# --- scans, hooks, windows ----------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS nat_n_nationkey, n_name AS nat_n_name FROM nation")
def scan_prefix_project(spark, folder):
    return load(spark, Table("nation", source(folder, "nation"), "nat", "n_nationkey", columns=("n_nationkey", "n_name")))


@query("SELECT p_partkey, upper(p_brand) AS p_brand, least(p_size, 40) AS p_size, length(p_name) AS p_length FROM part WHERE length(p_name) > 10 AND p_size > 5")
def hooks_annotate_filter_normalize(spark, folder):
    t = Table(
        "part", source(folder, "part", "p_"), "p", "partkey", columns=("partkey", "brand", "size", "name"),
        annotate=(Op("select", "*, length(p_name) as p_length"),),
        filter=(Op("where", "p_length > 10"), Op("where", "p_size > 5")),
        normalize=(lambda df: df.withColumns({"p_brand": F.upper("p_brand"), "p_size": F.least("p_size", F.lit(40))}).drop("p_name"),),
    )
    return run(spark, (t,), (), "part")


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE {IN}")
def pit_feature_window(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    return df.filter(in_features("o_orderdate", df.schema["o_orderdate"].dataType, CUT, WINDOW.back))


_DEEDS = "ts > TIMESTAMP '2023-01-01' AND ts < TIMESTAMP '2024-01-01'"


def _interactions(null_time: str):
    def f(spark, folder):
        df = spark.read.parquet(f"{folder}/notification_interactions.parquet")
        df = df.filter(in_features("ts", df.schema["ts"].dataType, datetime(2024, 1, 1), WINDOW.back, null_time))
        return df.groupBy("interaction_type_id").agg(F.count("*").alias("n"), F.count("ts").alias("n_ts"))

    return f


_TAIL = "GROUP BY interaction_type_id"
query(f"SELECT interaction_type_id, count(*) AS n, count(ts) AS n_ts FROM notification_interactions WHERE {_DEEDS} {_TAIL}", "pit_feature_window_drop_null")(_interactions("drop"))
query(f"SELECT interaction_type_id, count(*) AS n, count(ts) AS n_ts FROM notification_interactions WHERE {_DEEDS} OR ts IS NULL {_TAIL}", "pit_feature_window_keep_null")(_interactions("keep"))


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE {AFTER}")
def pit_label_window(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    return df.filter(in_label("o_orderdate", df.schema["o_orderdate"].dataType, CUT, WINDOW.ahead))


@query("""SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-09' AND ts < a) AS features, count(*) FILTER (WHERE ts > a AND ts < b) AS labels,
  count(*) FILTER (WHERE ts = a OR ts = b) AS at_bounds FROM events, (SELECT max(ts) AS a FROM events WHERE ts < TIMESTAMP '2024-01-10') x, (SELECT max(ts) + INTERVAL 3 DAY AS b FROM events WHERE ts < TIMESTAMP '2024-01-10') y""")
def window_boundary_exclusion(spark, folder):
    df = spark.read.parquet(f"{folder}/events.parquet").select("ts")
    cut = df.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).agg(F.max("ts")).first()[0]
    kind, w = df.schema["ts"].dataType, Window(cut, ((cut - datetime(2024, 1, 9)).total_seconds(), "second"), (3, "day"))
    at = (F.col("ts") == F.lit(cut).cast("timestamp_ntz")) | (F.col("ts") == F.lit(cut + w.ahead).cast("timestamp_ntz"))
    return df.agg(
        F.count_if(in_features("ts", kind, cut, w.back)).alias("features"), F.count_if(in_label("ts", kind, cut, w.ahead)).alias("labels"), F.count_if(at).alias("at_bounds")
    )


for _unit, _n, _s in (("second", 86400, 86400), ("minute", 90, 5400), ("hour", 30, 108000), ("day", 3, 259200), ("week", 2, 1209600), ("month", 1, 2628028.8), ("year", 1, 31536000)):

    def _by_unit(spark, folder, unit=_unit, n=_n):
        df = spark.read.parquet(f"{folder}/events.parquet")
        w = Window(datetime(2024, 1, 20), (n, unit))
        return df.filter(in_features("ts", df.schema["ts"].dataType, w.cut, w.back)).groupBy("event_type").agg(F.count("*").alias("n"))

    query(f"SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' AND epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-20') - {round(_s * 1e6)} GROUP BY event_type", f"period_units_{_unit}")(_by_unit)

# --- reduce and join ------------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, n AS o_n, total AS o_total, latest AS o_latest FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, sum({PRICE}) AS total, max(o_orderdate) AS latest FROM orders WHERE {IN} GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def pit_orders_per_customer(spark, folder):
    ops = (Op("agg", "count(*) as o_n, sum(o_totalprice) as o_total"), Op("agg", "max(o_orderdate) as o_latest"))
    return run(spark, (customer(folder), orders(folder, reduce=ops)), (CO,))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' AND l_discount > 0.02 GROUP BY l_returnflag, l_linestatus")
def reduce_ops_group_query(spark, folder):
    ops = (Op("where", "l_shipdate < timestamp_ntz '1998-09-02'"), Op("where", "l_discount > 0.02"), Op("key", "l_returnflag, l_linestatus"), Op("agg", "count(*) as n, sum(cast(l_quantity as decimal(18,2))) as quantity"))
    return compile_ops(spark.read.parquet(f"{folder}/lineitem.parquet"), ops)


@query("SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def reduce_having_order(spark, folder):
    ops = (Op("key", "o_custkey"), Op("agg", "count(*) as n, max(o_orderdate) as latest"), Op("having", "n >= 12"), Op("order", "n desc, o_custkey"))
    return compile_ops(spark.read.parquet(f"{folder}/orders.parquet"), ops)


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O'")
def ops_window(spark, folder):
    ops = (Op("where", "o_orderstatus = 'O'"), Op("window", "cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as n"), Op("select", "o_orderkey, o_custkey, n"))
    return compile_ops(spark.read.parquet(f"{folder}/orders.parquet"), ops)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ops_custom(spark, folder):
    return compile_ops(spark.read.parquet(f"{folder}/nation.parquet"), (Op("custom", "select n_regionkey, count(*) as n from {this} group by n_regionkey"),))


def _auto(spark, folder, columns, keep, annotate=(), policy=NO_TIME):
    o = orders(folder, columns=columns, annotate=annotate)
    return run(spark, (customer(folder), o), (CO,), policy=policy).select("c_custkey", *keep)


def _auto_sql(select: str) -> str:
    return f"SELECT c_custkey, o.* EXCLUDE (k) FROM customer LEFT JOIN (SELECT o_custkey AS k, {select} FROM orders WHERE {IN} GROUP BY o_custkey) o ON c_custkey = k"


_NUMERIC = f"round(median(CAST(o_totalprice AS DOUBLE)), 6) AS o_totalprice_median, round(avg(o_totalprice), 6) AS o_totalprice_mean, sum({PRICE}) AS o_totalprice_sum, min({PRICE}) AS o_totalprice_min, max({PRICE}) AS o_totalprice_max"


@query(_auto_sql(_NUMERIC))
def auto_numeric(spark, folder):
    keep = [f"o_totalprice_{f}" for f in ("median", "mean", "sum", "min", "max")]
    df = _auto(spark, folder, ("orderkey", "custkey", "totalprice", "orderdate"), keep, (money("o_totalprice"),))
    return rounded(df, 6, "o_totalprice_median", "o_totalprice_mean")


@query(_auto_sql("count(o_orderpriority) AS o_orderpriority_count, count(DISTINCT o_orderpriority) AS o_orderpriority_nunique"))
def auto_categorical(spark, folder):
    return _auto(spark, folder, ("orderkey", "custkey", "orderpriority", "orderdate"), ["o_orderpriority_count", "o_orderpriority_nunique"])


@query(_auto_sql("min(o_orderdate) AS o_orderdate_min, max(o_orderdate) AS o_orderdate_max"))
def auto_timestamp(spark, folder):
    return _auto(spark, folder, ("orderkey", "custkey", "orderdate"), ["o_orderdate_min", "o_orderdate_max"])


@query(_auto_sql("count(o_orderstatus = 'F') AS o_done_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS o_done_sum"))
def auto_boolean(spark, folder):
    flag = Op("select", "*, o_orderstatus = 'F' as o_done")
    return _auto(spark, folder, ("orderkey", "custkey", "orderstatus", "orderdate"), ["o_done_count", "o_done_sum"], (flag,))


@query(_auto_sql("count(o_orderkey) AS o_orderkey_count"))
def auto_identifiers(spark, folder):
    df = _auto(spark, folder, ("orderkey", "custkey", "orderdate"), ["*"])
    return df.select("c_custkey", *[c for c in df.columns if c.endswith("key_count")])


@query("SELECT label AS y_label, count(*) AS e_vec_id_count, round(arg_min(embedding[1], vec_id), 5) AS first_value FROM embeddings GROUP BY label")
def auto_embedding_first(spark, folder):
    labels = Table("labels", Source(fn=lambda s: s.read.parquet(f"{folder}/embeddings.parquet").select("label").distinct()), "y", "label")
    vectors = Table("embeddings", source(folder, "embeddings"), "e", "vec_id")
    df = run(spark, (labels, vectors), (Edge("labels", "embeddings", "label", "label"),), "labels", policy=NO_TIME)
    return df.select("y_label", "e_vec_id_count", F.round(F.col("e_embedding_first")[0], 5).alias("first_value"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL {d} DAY) AS o_num_events_{d}d" for d in (30, 90, 180, 365))
_RECENCY = "(epoch_us(TIMESTAMP '2000-01-01') - epoch_us(max(o_orderdate))) // 1000000 AS o_seconds_since_last"


@query(_auto_sql(f"{_NUMERIC}, count(o_orderkey) AS o_orderkey_count, min(o_orderdate) AS o_orderdate_min, max(o_orderdate) AS o_orderdate_max, {_RECENCY}, {_COUNTS}"))
def auto_features_orders(spark, folder):
    df = run(spark, (customer(folder), orders(folder)), (CO,), policy=FeaturePolicy(lookbacks=(30, 90, 180, 365), ratios=False))
    return rounded(df, 6, "o_totalprice_median", "o_totalprice_mean")


@query(_auto_sql(_COUNTS))
def lookback_counts(spark, folder):
    df = run(spark, (customer(folder), orders(folder)), (CO,), policy=FeaturePolicy(functions={}, lookbacks=(30, 90, 180, 365), ratios=False, recency=False))
    return df


@query(_auto_sql(", ".join(f"round(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL {a} DAY) / nullif(CAST(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL {b} DAY) AS DOUBLE), 0), 6) AS o_{a}dv{b}_change" for a, b in ((30, 90), (90, 180), (180, 365)))))
def lookback_ratios(spark, folder):
    df = run(spark, (customer(folder), orders(folder)), (CO,), policy=FeaturePolicy(functions={}, lookbacks=(30, 90, 180, 365), counts=False, recency=False))
    return rounded(df, 6, *[c for c in df.columns if c.endswith("_change")])


@query(_auto_sql(_RECENCY))
def recency_seconds(spark, folder):
    return run(spark, (customer(folder), orders(folder)), (CO,), policy=FeaturePolicy(functions={}, counts=False, ratios=False))


@query(f"""WITH g AS (SELECT *, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) // 1000000 AS gap FROM orders)
  SELECT c_custkey, x.* EXCLUDE (k) FROM customer LEFT JOIN (SELECT o_custkey AS k, min(gap) AS o_time_between_records_min, max(gap) AS o_time_between_records_max, CAST(sum(gap) AS BIGINT) AS o_time_between_records_sum
  FROM g WHERE {IN} GROUP BY o_custkey) x ON c_custkey = k""")
def gap_lag_seconds(spark, folder):
    policy = FeaturePolicy(functions={"numerical": ("sum", "min", "max")}, counts=False, ratios=False, recency=False, gaps=True)
    df = run(spark, (customer(folder), orders(folder, columns=("orderkey", "custkey", "orderdate"), annotate=())), (CO,), policy=policy)
    return df.select("c_custkey", *[c for c in df.columns if "between" in c])


_SUMS = FeaturePolicy(functions={"numerical": ("sum", "max"), "identifier": ("count",)}, counts=False, ratios=False, recency=False, hop_functions=("sum", "max"))
_LINES = """(SELECT l_orderkey, count(l_linenumber) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS m
  FROM lineitem WHERE l_shipdate > TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY l_orderkey)"""
_TWO = f"""SELECT o_custkey AS k, CAST(sum(l.n) AS BIGINT) AS l_linenumber_count_sum, max(l.n) AS l_linenumber_count_max, sum(l.s) AS l_extendedprice_sum_sum, max(l.s) AS l_extendedprice_sum_max,
  sum(l.m) AS l_extendedprice_max_sum, max(l.m) AS l_extendedprice_max_max, count(o_orderkey) AS o_orderkey_count, sum({PRICE}) AS o_totalprice_sum, max({PRICE}) AS o_totalprice_max
  FROM orders LEFT JOIN {_LINES} l ON o_orderkey = l_orderkey WHERE {IN} GROUP BY o_custkey"""


@query(f"SELECT c_custkey, x.* EXCLUDE (k) FROM customer LEFT JOIN ({_TWO}) x ON c_custkey = k")
def two_hop_lineitem_orders_customer(spark, folder):
    return run(spark, (customer(folder), orders(folder), lineitem(folder)), (CO, OL), policy=_SUMS)


@query(f"""SELECT n_nationkey, y.* EXCLUDE (k) FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(c_custkey) AS c_custkey_count, CAST(sum(o_orderkey_count) AS BIGINT) AS o_orderkey_count_sum, sum(o_totalprice_sum) AS o_totalprice_sum_sum,
  CAST(sum(l_linenumber_count_sum) AS BIGINT) AS l_linenumber_count_sum_sum, sum(l_extendedprice_sum_sum) AS l_extendedprice_sum_sum_sum
  FROM customer LEFT JOIN ({_TWO}) x ON c_custkey = k GROUP BY c_nationkey) y ON n_nationkey = k""")
def three_hop_nation_rollup(spark, folder):
    nation = Table("nation", source(folder, "nation", "n_"), "n", "nationkey", columns=("nationkey",))
    policy = FeaturePolicy(functions={"numerical": ("sum",), "identifier": ("count",)}, counts=False, ratios=False, recency=False, hop_functions=("sum",))
    tables = (nation, customer(folder, columns=("custkey", "nationkey")), orders(folder), lineitem(folder))
    return run(spark, tables, (Edge("nation", "customer", "nationkey", "nationkey"), CO, OL), "nation", policy=policy)


@query(f"SELECT c_custkey, n AS o_orderkey_count FROM customer LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders WHERE {IN} GROUP BY o_custkey) o ON c_custkey = o_custkey")
def hops_back_limit(spark, folder):
    df = run(spark, (customer(folder), orders(folder), lineitem(folder)), (CO, OL), policy=_SUMS, back_hops=1)
    if any(c.startswith("l_") for c in df.columns):
        raise AssertionError("the limit of hops was passed")
    return df.select("c_custkey", "o_orderkey_count")


@query("""SELECT s_suppkey, a.n AS l_n, b.n AS m_n, b.q AS m_q FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) a ON a.l_suppkey = s_suppkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) b ON b.l_suppkey = s_suppkey""")
def diamond_alias(spark, folder):
    s = Table("supplier", source(folder, "supplier", "s_"), "s", "suppkey", columns=("suppkey",))
    l = Table("lineitem", source(folder, "lineitem", "l_"), "l", "linenumber", columns=("linenumber", "suppkey", "quantity", "returnflag"))
    from dataclasses import replace

    m = replace(l.alias("m", "returned"), filter=(Op("where", "m_returnflag = 'R'"),), reduce=(Op("agg", "count(*) as m_n, sum(cast(m_quantity as bigint)) as m_q"),))
    tables = (s, replace(l, reduce=(Op("agg", "count(*) as l_n"),)), m)
    return run(spark, tables, (Edge("supplier", "lineitem", "suppkey", "suppkey"), Edge("supplier", "returned", "suppkey", "suppkey")), "supplier")


@query("SELECT c_custkey, c_nationkey, n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def front_join_nation_region(spark, folder):
    tables = (
        customer(folder, columns=("custkey", "nationkey")),
        Table("nation", source(folder, "nation", "n_"), "n", "nationkey", columns=("nationkey", "name", "regionkey")),
        Table("region", source(folder, "region", "r_"), "r", "regionkey", columns=("regionkey", "name")),
    )
    return run(spark, tables, (Edge("nation", "customer", "nationkey", "nationkey"), Edge("region", "nation", "regionkey", "regionkey")), front_hops=2)


def _grain(windowed: bool):
    return lambda spark, folder: run(spark, (customer(folder), orders(folder)), (Edge("customer", "orders", "custkey", "custkey", reduce=False, windowed=windowed),))


_ROWS = f"SELECT c_custkey, o_orderkey, {PRICE} AS o_totalprice, o_orderdate FROM customer LEFT JOIN orders ON c_custkey = o_custkey"
query(_ROWS, "preserve_child_grain")(_grain(False))
query(f"{_ROWS} AND {IN}", "preserve_child_grain_windowed")(_grain(True))


@query(f"SELECT c_custkey, count(o_orderkey) AS n, max({PRICE}) AS largest FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND {IN} GROUP BY c_custkey")
def reduce_after_join(spark, folder):
    c = customer(folder, after_join_reduce=(Op("key", "c_custkey"), Op("agg", "count(o_orderkey) as n, max(o_totalprice) as largest")))
    return run(spark, (c, orders(folder)), (Edge("customer", "orders", "custkey", "custkey", reduce=False, reduce_after_join=True),))


@query(_auto_sql(f"count(*) FILTER (WHERE o_totalprice > 100000) AS o_large, count(o_orderkey) AS o_orderkey_count, sum({PRICE}) AS o_totalprice_sum, max({PRICE}) AS o_totalprice_max"))
def custom_plus_auto_fused(spark, folder):
    o = orders(folder, reduce=(Op("agg", "count_if(o_totalprice > 100000) as o_large"),))
    return run(spark, (customer(folder), o), (CO,), policy=_SUMS)


@query("SELECT c_custkey, CAST(NULL AS BIGINT) AS o_n FROM customer")
def empty_window_yields_nulls(spark, folder):
    return run(spark, (customer(folder), orders(folder, reduce=(Op("agg", "count(*) as o_n"),))), (CO,), window=Window(datetime(1990, 1, 1)))


@query()
def approx_values(spark, folder):
    """The approximate median and distinct count themselves, which SQL can't say exactly: a test holds them to exact ones."""
    policy = FeaturePolicy(functions={"numerical": ("median",), "categorical": ("nunique",)}, counts=False, ratios=False, recency=False, median="approx", distinct="approx")
    df = run(spark, (customer(folder), orders(folder, columns=("orderkey", "custkey", "totalprice", "orderpriority", "orderdate"))), (CO,), policy=policy)
    return df.select("c_custkey", "o_totalprice_median", "o_orderpriority_nunique")


# --- labels ---------------------------------------------------------------------------------------------------------------

_COUNT = (Op("agg", "count(*) as o_n"),)


def _label(spark, folder, *labels, **more):
    return run(spark, (customer(folder), orders(folder, reduce=_COUNT)), (CO,), labels=labels, **more)


def _label_sql(label: str) -> str:
    return f"""SELECT c_custkey, o_n, z.* EXCLUDE (k) FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS o_n FROM orders WHERE {IN} GROUP BY o_custkey) x ON c_custkey = o_custkey
  LEFT JOIN (SELECT o_custkey AS k, {label} FROM orders WHERE {AFTER} GROUP BY o_custkey) z ON c_custkey = k"""


query(_label_sql("count(o_orderkey) AS o_orderkey_label"), "label_count")(lambda s, d: _label(s, d, LabelSpec("orders", "count", "orderkey")))
query(_label_sql(f"sum({PRICE}) AS o_totalprice_label"), "label_sum")(lambda s, d: _label(s, d, LabelSpec("orders", "sum", "totalprice")))
query(_label_sql("CAST(count(o_orderkey) >= 1 AS INTEGER) AS o_orderkey_label"), "label_bool")(lambda s, d: _label(s, d, LabelSpec("orders", "bool", "orderkey")))
query(_label_sql(f"max({PRICE}) - min({PRICE}) AS o_totalprice_label"), "label_callable")(lambda s, d: _label(s, d, LabelSpec("orders", lambda c: F.max(c) - F.min(c), "totalprice")))
query(_label_sql("CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o_open_label"), "label_custom_conditional_sum")(
    lambda s, d: run(s, (customer(d), orders(d, columns=("orderkey", "custkey", "orderstatus", "orderdate"), annotate=(), reduce=_COUNT)), (CO,), labels=(LabelSpec("orders", (Op("agg", "sum(case when o_orderstatus = 'O' then 1 else 0 end) as o_open_label"),)),))
)
query(_label_sql("count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS o_kinds_label"), "label_conditional_distinct")(
    lambda s, d: run(s, (customer(d), orders(d, columns=("orderkey", "custkey", "orderstatus", "orderpriority", "orderdate"), annotate=(), reduce=_COUNT)), (CO,), labels=(LabelSpec("orders", (Op("agg", "count(distinct case when o_orderstatus = 'O' then o_orderpriority end) as o_kinds_label"),)),))
)
query(_label_sql("round(count(*) FILTER (WHERE o_totalprice > 100000) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS o_share_label"), "label_ratio")(
    lambda s, d: _label(s, d, LabelSpec("orders", (Op("agg", "round(try_divide(cast(count_if(o_totalprice > 100000) as double), count(*)), 6) as o_share_label"),)))
)
query(_label_sql("count(o_orderkey) AS o_orderkey_label").replace("z.* EXCLUDE (k)", "coalesce(z.o_orderkey_label, 0) AS o_orderkey_label"), "label_fill_zero")(lambda s, d: _label(s, d, LabelSpec("orders", "count", "orderkey", fill=0)))


@query(f"SELECT c_custkey, z.o_totalprice_label FROM customer LEFT JOIN (SELECT o_custkey, {PRICE} AS o_totalprice_label FROM orders WHERE {AFTER}) z ON c_custkey = z.o_custkey")
def label_unreduced(spark, folder):
    return _label(spark, folder, LabelSpec("orders", "sum", "totalprice", reduce=False)).drop("o_n")


_SHIP = "l_shipdate > TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2000-03-31'"


@query(f"""SELECT c_custkey, x.* EXCLUDE (k) FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS o_n, CAST(sum(n) AS BIGINT) AS l_linenumber_label_sum_label, max(n) AS l_linenumber_label_max_label FROM orders LEFT JOIN
  (SELECT l_orderkey, count(l_linenumber) AS n FROM lineitem WHERE {_SHIP} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey WHERE {IN} GROUP BY o_custkey) x ON c_custkey = k""")
def label_grandchild_propagated(spark, folder):
    tables = (customer(folder), orders(folder, reduce=_COUNT), lineitem(folder, reduce=(Op("agg", "count(*) as l_n"),)))
    return run(spark, tables, (CO, OL), labels=(LabelSpec("lineitem", "count", "linenumber", propagate=("sum", "max")),))


@query("""WITH n AS (SELECT id, any_value(customer_id) AS customer_id, min(loaded_at) AS loaded_at FROM notifications GROUP BY id), o AS (SELECT id, any_value(customer_id) AS customer_id, min(loaded_at) AS loaded_at FROM cust_orders GROUP BY id)
  SELECT c.id AS cu_id, CAST(coalesce(a.v, 0) + coalesce(b.v, 0) > 0 AS INTEGER) AS engaged FROM (SELECT DISTINCT id FROM cust) c
  LEFT JOIN (SELECT customer_id, count(id) AS v FROM n WHERE loaded_at > TIMESTAMP '2024-01-01' AND loaded_at < TIMESTAMP '2024-03-31' GROUP BY customer_id) a ON a.customer_id = c.id
  LEFT JOIN (SELECT customer_id, count(id) AS v FROM o WHERE loaded_at > TIMESTAMP '2024-01-01' AND loaded_at < TIMESTAMP '2024-03-31' GROUP BY customer_id) b ON b.customer_id = c.id""")
def label_multi_table_union_flag(spark, folder):
    tables, edges = _domain(folder, ("orders", "notifications"))
    df = run(spark, tables, edges, "cust", Window(datetime(2024, 1, 1), (365, "day"), (90, "day")), labels=(LabelSpec("orders", "count", "id", fill=0), LabelSpec("notifications", "count", "id", fill=0)))
    return df.select("cu_id", (F.col("or_id_label") + F.col("no_id_label") > 0).cast("int").alias("engaged"))


# --- the reference's six tables --------------------------------------------------------------------------------------------


def _once(folder: str, name: str, columns: tuple[str, ...], time: bool = True) -> Source:
    """One row per record: copies agree but for when they were loaded."""

    def read(spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        aggs = [F.max(c).alias(c) for c in columns] + ([F.min("loaded_at").alias("loaded_at")] if time else [])
        return df.groupBy("id").agg(*aggs) if aggs else df.select("id").distinct()

    return Source(fn=read)


def _domain(folder: str, names: tuple[str, ...], cut_counts: bool = True):
    count = lambda p: (Op("agg", f"count({p}_id) as {p}_n"),)
    every = {
        "orders": Table("orders", _once(folder, "cust_orders", ("customer_id", "amount")), "or", "id", "loaded_at", reduce=count("or")),
        "products": Table("products", _once(folder, "order_products", ("order_id", "product_id")), "op", "id", "loaded_at", reduce=count("op")),
        "notifications": Table("notifications", _once(folder, "notifications", ("customer_id",)), "no", "id", "loaded_at", reduce=count("no")),
        "types": Table("types", Source(path=f"{folder}/notification_interaction_types.parquet"), "ty", "id", reduce=(Op("agg", "count(ty_name) as ty_n"),)),
        "interactions": Table("interactions", _once(folder, "notification_interactions", ("notification_id", "interaction_type_id", "ts")), "ni", "id", "loaded_at", reduce=count("ni")),
    }
    edges = {
        "orders": Edge("cust", "orders", "id", "customer_id"),
        "products": Edge("orders", "products", "id", "order_id"),
        "notifications": Edge("cust", "notifications", "id", "customer_id"),
        "interactions": Edge("notifications", "interactions", "id", "notification_id"),
        "types": Edge("interactions", "types", "interaction_type_id", "id"),
    }
    return (Table("cust", _once(folder, "cust", (), False), "cu", "id"), *(every[n] for n in names)), tuple(edges[n] for n in names)


@query("""WITH w AS (SELECT TIMESTAMP '2023-01-01' AS a, TIMESTAMP '2024-01-01' AS b),
  o AS (SELECT id, any_value(customer_id) AS customer_id, any_value(amount) AS amount, min(loaded_at) AS l FROM cust_orders GROUP BY id),
  p AS (SELECT id, any_value(order_id) AS order_id, min(loaded_at) AS l FROM order_products GROUP BY id),
  n AS (SELECT id, any_value(customer_id) AS customer_id, min(loaded_at) AS l FROM notifications GROUP BY id),
  i AS (SELECT id, any_value(notification_id) AS notification_id, min(loaded_at) AS l FROM notification_interactions GROUP BY id),
  pp AS (SELECT order_id, count(id) AS v FROM p, w WHERE l > a AND l < b GROUP BY order_id),
  ii AS (SELECT notification_id, count(id) AS v FROM i, w WHERE l > a AND l < b GROUP BY notification_id),
  oo AS (SELECT customer_id, count(o.id) AS or_id_count, CAST(sum(amount) AS BIGINT) AS or_amount_sum, max(amount) AS or_amount_max, CAST(sum(pp.v) AS BIGINT) AS op_n_sum, max(pp.v) AS op_n_max FROM w, o LEFT JOIN pp ON pp.order_id = o.id WHERE l > a AND l < b GROUP BY customer_id),
  nn AS (SELECT customer_id, count(n.id) AS no_id_count, CAST(sum(ii.v) AS BIGINT) AS ni_n_sum, max(ii.v) AS ni_n_max FROM w, n LEFT JOIN ii ON ii.notification_id = n.id WHERE l > a AND l < b GROUP BY customer_id)
  SELECT c.id AS cu_id, or_id_count, or_amount_sum, or_amount_max, op_n_sum, op_n_max, no_id_count, ni_n_sum, ni_n_max FROM (SELECT DISTINCT id FROM cust) c LEFT JOIN oo ON oo.customer_id = c.id LEFT JOIN nn ON nn.customer_id = c.id""")
def cust_five_tables(spark, folder):
    tables, edges = _domain(folder, ("orders", "products", "notifications", "interactions"))
    df = run(spark, tables, edges, "cust", Window(datetime(2024, 1, 1)), policy=_SUMS)
    return df.select("cu_id", "or_id_count", "or_amount_sum", "or_amount_max", "op_n_sum", "op_n_max", "no_id_count", "ni_n_sum", "ni_n_max")


# --- hooks after joins, cohorts, enrichment ---------------------------------------------------------------------------------

_NB = """WITH o AS (SELECT customer_id, count(*) AS v FROM (SELECT id, any_value(customer_id) AS customer_id, min(loaded_at) AS l FROM cust_orders GROUP BY id) x WHERE l > TIMESTAMP '2023-01-01' AND l < TIMESTAMP '2024-01-01' GROUP BY customer_id),
  n AS (SELECT customer_id, count(*) AS v FROM (SELECT id, any_value(customer_id) AS customer_id, min(loaded_at) AS l FROM notifications GROUP BY id) x WHERE l > TIMESTAMP '2023-01-01' AND l < TIMESTAMP '2024-01-01' GROUP BY customer_id),
  r AS (SELECT c.id AS cu_id, o.v AS or_n, n.v AS no_n, CAST(n.v AS DOUBLE) / nullif(o.v, 0) AS ratio FROM (SELECT DISTINCT id FROM cust) c LEFT JOIN o ON o.customer_id = c.id LEFT JOIN n ON n.customer_id = c.id)"""


def _hooked(spark, folder, *hooks):
    tables, edges = _domain(folder, ("orders", "notifications"))
    from dataclasses import replace

    return run(spark, (replace(tables[0], after_join=hooks), *tables[1:]), edges, "cust", Window(datetime(2024, 1, 1)))


_RATIO = Hook(ops=(Op("select", "*, round(try_divide(cast(no_n as double), or_n), 6) as ratio"),), requires=("orders", "notifications"))


@query(f"{_NB} SELECT cu_id, or_n, no_n, round(ratio, 6) AS ratio FROM r")
def post_join_annotate_requires(spark, folder):
    return _hooked(spark, folder, _RATIO)


@query(f"{_NB} SELECT cu_id, or_n, no_n, round(ratio, 6) AS ratio FROM r WHERE ratio >= 2")
def post_join_filter_requires(spark, folder):
    return _hooked(spark, folder, _RATIO, Hook(ops=(Op("where", "ratio >= 2"),), requires=("notifications", "orders")))


_PAST = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1996-01-01')"


def _tables(spark, folder):
    return spark.read.parquet(f"{folder}/customer.parquet"), spark.read.parquet(f"{folder}/orders.parquet")


@query(f"SELECT c_custkey FROM customer WHERE {_PAST}")
def cohort_exists(spark, folder):
    c, o = _tables(spark, folder)
    old = o.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return c.join(old, c.c_custkey == old.o_custkey, "left_semi").select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE {_PAST} OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def cohort_exists_or(spark, folder):
    c, o = _tables(spark, folder)
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    early = "r.o_custkey = l.c_custkey AND r.o_orderdate < timestamp_ntz '1996-01-01'"
    return where_exists(c.select("c_custkey", "c_nationkey"), (o, early), (nation, "r.n_nationkey = l.c_nationkey AND r.n_regionkey = 1")).select("c_custkey")


@query(f"SELECT c_custkey, {_PAST} AS early FROM customer")
def flag_exists(spark, folder):
    c, o = _tables(spark, folder)
    return with_existence(c.select("c_custkey"), o, "r.o_custkey = l.c_custkey AND r.o_orderdate < timestamp_ntz '1996-01-01'", "early")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate <= o_orderdate + INTERVAL 7 DAY) AS quick FROM orders")
def existence_range_condition(spark, folder):
    _, o = _tables(spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    on = "r.l_orderkey = l.o_orderkey AND r.l_shipdate <= l.o_orderdate + INTERVAL 7 DAYS"
    return with_existence(o.select("o_orderkey", "o_orderdate"), lines, on, "quick").drop("o_orderdate")


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(p_retailprice, l_extendedprice) AS DECIMAL(18,2)) AS amount FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey")
def enrich_left_join_coalesce(spark, folder):
    l = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    p = spark.read.parquet(f"{folder}/part.parquet").filter("p_size > 25").select("p_partkey", "p_retailprice")
    return l.join(p, l.l_partkey == p.p_partkey, "left").select("l_orderkey", "l_linenumber", F.coalesce("p_retailprice", "l_extendedprice").cast("decimal(18,2)").alias("amount"))


# --- scalar functions -------------------------------------------------------------------------------------------------------


def _scalars(name: str, table: str, spark_text: str, sql: str) -> None:
    query(f"SELECT {sql} FROM {table}", name)(lambda spark, folder: compile_ops(spark.read.parquet(f"{folder}/{table}.parquet"), (Op("select", spark_text),)))


_scalars("scalar_string", "part", "p_partkey, length(p_name) as n, lower(trim(p_brand)) as brand, p_type like '%A%' as has_a, coalesce(nullif(p_name, ''), '-') as name, p_brand in ('Brand#11', 'Brand#12') as picked",
         "p_partkey, length(p_name) AS n, lower(trim(p_brand)) AS brand, p_type LIKE '%A%' AS has_a, coalesce(nullif(p_name, ''), '-') AS name, p_brand IN ('Brand#11', 'Brand#12') AS picked")
_scalars("scalar_date", "orders", "o_orderkey, date_format(o_orderdate, 'MM') as month, date_format(o_orderdate, 'yyyy-MM-dd') as day, cast(datediff(timestamp_ntz '2001-12-31', o_orderdate) as bigint) as days, cast(timestampdiff(SECOND, o_orderdate, timestamp_ntz '2001-12-31') as bigint) as seconds",
         "o_orderkey, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day, date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') AS days, (epoch_us(TIMESTAMP '2001-12-31') - epoch_us(o_orderdate)) // 1000000 AS seconds")
_scalars("scalar_cast_try", "part", "p_partkey, cast(p_size as double) as size_double, cast(p_partkey as string) as key_text, try_cast(p_brand as int) as no_number, try_cast(cast(p_size as string) as int) as size, try_divide(p_size, p_size - p_size) as nothing",
         "p_partkey, CAST(p_size AS DOUBLE) AS size_double, CAST(p_partkey AS VARCHAR) AS key_text, TRY_CAST(p_brand AS INTEGER) AS no_number, TRY_CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS size, CAST(NULL AS DOUBLE) AS nothing")
_scalars("scalar_case", "customer", "c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 1000 then 'low' else 'high' end as class, case when c_mktsegment is null or c_mktsegment != 'BUILDING' then 0 else 1 end as builds",
         "c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS class, CASE WHEN c_mktsegment IS NULL OR c_mktsegment != 'BUILDING' THEN 0 ELSE 1 END AS builds")

# --- tasks -------------------------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, o_n, CAST(coalesce(z.n, 0) = 0 AS INTEGER) AS churned FROM customer JOIN (SELECT o_custkey AS k, count(*) AS o_n FROM orders WHERE {IN} GROUP BY o_custkey) x ON c_custkey = x.k
  LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE {AFTER} GROUP BY o_custkey) z ON c_custkey = z.k""")
def churn_task(spark, folder):
    df = _label(spark, folder, LabelSpec("orders", "count", "orderkey", fill=0)).filter("o_n is not null")
    return df.select("c_custkey", "o_n", (F.col("o_orderkey_label") == 0).cast("int").alias("churned"))


@query(_label_sql(f"sum({PRICE}) AS ltv").replace("z.* EXCLUDE (k)", "CAST(coalesce(z.ltv, 0) AS DECIMAL(28,2)) AS ltv"))
def ltv_task(spark, folder):
    df = _label(spark, folder, LabelSpec("orders", "sum", "totalprice"))
    return df.select("c_custkey", "o_n", F.coalesce("o_totalprice_label", F.lit(0)).cast("decimal(28,2)").alias("ltv"))


@query("""SELECT u.user_id AS u_user_id, x.n AS e_n, round(z.r, 6) AS ctr FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id) x ON x.user_id = u.user_id
  LEFT JOIN (SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) / nullif(count(*), 0) AS r FROM events WHERE ts > TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25' GROUP BY user_id) z ON z.user_id = u.user_id""")
def ctr_task(spark, folder):
    users = Table("users", Source(fn=lambda s: s.read.parquet(f"{folder}/events.parquet").select("user_id").distinct()), "u", "user_id")
    events = Table("events", source(folder, "events"), "e", "event_id", "ts", columns=("event_id", "ts", "user_id", "event_type"), reduce=(Op("agg", "count(*) as e_n"),))
    label = LabelSpec("events", (Op("agg", "round(try_divide(cast(count_if(e_event_type = 'click') as double), count(*)), 6) as ctr"),))
    return run(spark, (users, events), (Edge("users", "events", "user_id", "user_id"),), "users", Window(datetime(2024, 1, 20), (7, "day"), (5, "day")), labels=(label,))


@query("""SELECT u.user_id AS u_user_id, CAST(coalesce(z.n, 0) > 0 AS INTEGER) AS engaged, x.n AS e_event_id_count, x.k AS e_event_type_nunique FROM (SELECT DISTINCT user_id FROM events) u
  LEFT JOIN (SELECT user_id, count(event_id) AS n, count(DISTINCT event_type) AS k FROM events WHERE ts > TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id) x ON x.user_id = u.user_id
  LEFT JOIN (SELECT user_id, count(event_id) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21' GROUP BY user_id) z ON z.user_id = u.user_id""")
def engagement_task(spark, folder):
    users = Table("users", Source(fn=lambda s: s.read.parquet(f"{folder}/events.parquet").select("user_id").distinct()), "u", "user_id")
    events = Table("events", source(folder, "events"), "e", "event_id", "ts", columns=("event_id", "ts", "user_id", "event_type"))
    df = run(spark, (users, events), (Edge("users", "events", "user_id", "user_id"),), "users", Window(datetime(2024, 1, 20), (7, "day"), (1, "day")), NO_TIME, labels=(LabelSpec("events", "bool", "event_id", fill=0),))
    return df.select("u_user_id", F.col("e_event_id_label").alias("engaged"), "e_event_id_count", "e_event_type_nunique")


@query(SQL["pit_orders_per_customer"])
def checkpoint_roundtrip(spark, folder):
    return checkpoint(pit_orders_per_customer(spark, folder))


@query("""SELECT user_id, cut, count(*) AS num_events FROM (SELECT user_id, ts, unnest(generate_series(0, 6)) AS i FROM events) e, LATERAL (SELECT date_trunc('day', ts) + INTERVAL 1 DAY + i * INTERVAL 1 DAY AS cut) c GROUP BY user_id, cut""")
def sliding_event_counts(spark, folder):
    return streaming_counts(spark.read.parquet(f"{folder}/events.parquet"), "user_id", "ts").withColumn("cut", F.col("cut").cast("timestamp_ntz"))
