"""Queries of what the engine does besides features of the plain kind: sources, stores, views, the command line, walks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions.temporal import clean_times
from ..operators.join import left_join
from ..operators.ops import compile_ops
from ..operators.rolling import rolling_totals
from ..operators.skew import per_key_results
from ..plans import Edge, EntityGraph, FeaturePolicy, Hook, LabelSpec, Op, Source, Table, Window, plan
from ..session import checkpoint, work_folder
from ..sources.readers import files_view, load, pick, sample
from ..sources.store import Store, replace_table
from .features import AFTER, CO, CUT, IN, NO_TIME, PRICE, WINDOW, _auto, _auto_sql, _domain, _label, _label_sql, customer, lineitem, orders, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return add


# --- sources and stores ---------------------------------------------------------------------------------------------------

FORMATS = ("parquet", "csv", "tsv", "json", "orc")
_SUPPLIERS = "s_suppkey AS s_suppkey, s_nationkey AS s_nationkey, s_name AS s_name"


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/supplier.parquet").select(*[F.col(f"s_{c}").alias(c) for c in ("suppkey", "nationkey", "name")])


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    return df.select(F.lit(tag).alias("kind"), F.col("s_suppkey").cast("bigint").alias("s_suppkey"), F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_name")


@query(f"SELECT unnest([{', '.join(repr(f) for f in FORMATS)}]) AS kind, {_SUPPLIERS} FROM supplier")
def source_formats(spark, folder):
    """A table in files of each format, under a path with a blank and quotes, scanned by path, format and options."""
    root, out = f"{work_folder(spark)}/it's a folder", None
    for kind in FORMATS:
        path = Store(root, format=kind).write(_suppliers(spark, folder), f"{kind}.files")
        part = _tagged(load(spark, Table("supplier", Source(path=path, format=kind), "s", "suppkey", columns=("suppkey", "nationkey", "name"))), kind)
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
def source_sql_path(spark, folder):
    """Files named in SQL by format and quoted path."""
    path = Store(work_folder(spark)).write(spark.read.parquet(f"{folder}/nation.parquet"), "nation files")
    return spark.sql(f"SELECT n_regionkey AS r, count(*) AS n FROM parquet.`{path}` GROUP BY n_regionkey")


@query("SELECT n_nationkey AS nat_nationkey, n_name AS nat_name, CAST(v.x AS INTEGER) AS version FROM nation, (SELECT unnest([1, 2]) AS x) v WHERE v.x = 2 OR n_regionkey < 3")
def source_catalog_table(spark, folder):
    """A table of the catalog, by name, before and after it was replaced; a reader of the old version is still served."""
    nation = spark.read.parquet(f"{folder}/nation.parquet").withColumnsRenamed({"n_nationkey": "nationkey", "n_name": "name"})
    root = work_folder(spark)
    name = "nation_" + root.rsplit("-", 1)[1]
    t = Table("nation", Source(table=name), "nat", "nationkey", columns=("nationkey", "name"))
    replace_table(nation.filter("n_regionkey < 3"), name, root=root)
    first = load(spark, t).withColumn("version", F.lit(1))
    replace_table(nation, name, root=root)
    second = load(spark, t).withColumn("version", F.lit(2))
    out = first.unionByName(second)
    spark.sql(f"DROP VIEW {name}")  # the frames have resolved it
    return out


@query(f"SELECT unnest([{', '.join(repr(f) for f in FORMATS)}]) AS kind, {_SUPPLIERS} FROM supplier")
def store_roundtrip(spark, folder):
    """Written to a store and read back, in each format."""
    root = work_folder(spark)
    parts = [_tagged(Store(root, format=k).cut(_suppliers(spark, folder), k).withColumnsRenamed({c: f"s_{c}" for c in ("suppkey", "nationkey", "name")}), k) for k in FORMATS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT * FROM (VALUES ('local', 'file:///data/t'), ('s3', 's3a://data/t'), ('gcs', 'gs://data/t'), ('blob', 'abfss://data/t'), ('hdfs', 'hdfs://data/t'), ('databricks', 'dbfs:/data/t'), ('none', '/data/t')) v(provider, path)""")
def store_providers(spark, folder):
    kinds = ("local", "s3", "gcs", "blob", "hdfs", "databricks", None)
    return spark.createDataFrame([(k or "none", Store("/data", k).path("t")) for k in kinds], "provider string, path string")


@query("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation WHERE n_nationkey % 2 = 0")
def source_view_of_files(spark, folder):
    """A view over files, without the rows that don't parse."""
    path = f"{work_folder(spark)}/mixed"
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    line = F.concat_ws(",", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise("bad"), F.regexp_replace("n_name", ",", " "))
    nation.select(line.alias("value")).write.text(path)
    files_view(spark, "mixed_files", Source(path=path, format="csv", schema="k bigint, name string", options={"mode": "DROPMALFORMED", "header": False}))
    return spark.sql("SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM mixed_files")


@query("SELECT least(count(*), 1000) AS n, TRUE AS among FROM customer")
def source_sample(spark, folder):
    """A sample has as many rows as asked for, or all there are, each of the table; which ones is not said."""
    c = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey")
    some = sample(c, 1000)
    return some.join(c.withColumn("own", F.lit(True)), "c_custkey", "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("own", F.lit(False))).alias("among"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer")
def source_pick_columns(spark, folder):
    c = spark.read.parquet(f"{folder}/customer.parquet")
    return c.select(F.col(pick(c.columns, ("id", "C_CUSTKEY"))).alias("k"), F.col(pick(c.columns, ("C_Name",))).alias("name"))


@query(f"SELECT c_custkey, n AS o_n, CAST(2 * s AS DECIMAL(30,2)) AS o_twice FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum({PRICE}) AS s FROM orders WHERE {IN} GROUP BY o_custkey) o ON c_custkey = o_custkey")
def hook_kept_in_store(spark, folder):
    """A hook whose result is kept in a store and read from there, and the whole as a view of the session."""
    keep = Hook(fn=lambda df: df.withColumn("o_double", F.col("o_totalprice") * 2), store=Store(work_folder(spark)), name="orders_hooked")
    o = orders(folder)
    o = replace(o, annotate=(*o.annotate, keep), reduce=(Op("agg", "count(*) as o_n, sum(o_double) as o_twice"),))
    plan(EntityGraph((customer(folder), o), (CO,), "customer", WINDOW, FeaturePolicy(enabled=False))).run(spark, view="hooked_customers")
    return spark.sql("SELECT c_custkey, o_n, CAST(o_twice AS DECIMAL(30,2)) AS o_twice FROM hooked_customers")


@query(_auto_sql(f"sum({PRICE}) AS o_total_sum, count(o_orderkey) AS o_orderkey_count").replace("c_custkey, o.*", "c_custkey AS c_custkey, o.*"))
def command_line(spark, folder):
    """The command line over a folder of files, its output read back."""
    root = work_folder(spark)
    store = Store(root)
    store.write(spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("custkey")), "customers.parquet")
    o = spark.read.parquet(f"{folder}/orders.parquet")
    store.write(o.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("orderdate"), F.col("o_totalprice").cast("decimal(18,2)").alias("total")), "orders.parquet")
    edges = [{"parent": "customers.parquet", "child": "orders.parquet", "parent_key": "custkey", "child_key": "custkey"}]
    cli.main(
        [root, "--target", "customers.parquet", "--prefixes", json.dumps({"customers.parquet": "c", "orders.parquet": "o"}), "--keys", json.dumps({"customers.parquet": "custkey", "orders.parquet": "orderkey"}),
         "--times", json.dumps({"orders.parquet": "orderdate"}), "--edges", json.dumps(edges), "--cut", CUT.isoformat(), "--output", f"{root}/out"]
    )
    return spark.read.parquet(f"{root}/out").select("c_custkey", "o_total_sum", "o_orderkey_count")


# --- features and labels --------------------------------------------------------------------------------------------------


@query(_auto_sql("CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS o_done_sum, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS o_done_mean"))
def auto_binary(spark, folder):
    """A column of 0 and 1, declared as such."""
    flag = Op("select", "*, case when o_orderstatus = 'F' then 1 else 0 end as o_done")
    o = replace(orders(folder, columns=("orderkey", "custkey", "orderstatus", "orderdate"), annotate=(flag,)), binary_columns=frozenset({"done"}))
    df = run(spark, (customer(folder), o), (CO,), policy=NO_TIME)
    return df.select("c_custkey", F.col("o_done_sum").cast("bigint").alias("o_done_sum"), F.round("o_done_mean", 6).alias("o_done_mean"))


@query(_label_sql("max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o_any_label"))
def label_max_of_flags(spark, folder):
    o = orders(folder, columns=("orderkey", "custkey", "orderstatus", "orderdate"), annotate=(), reduce=(Op("agg", "count(*) as o_n"),))
    return run(spark, (customer(folder), o), (CO,), labels=(LabelSpec("orders", (Op("agg", "max(case when o_orderstatus = 'O' then 1 else 0 end) as o_any_label"),)),))


@query(_label_sql(f"count(o_orderkey) AS o_orderkey_label, sum({PRICE}) AS o_totalprice_label, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS o_large_label"))
def labels_fused(spark, folder):
    """Several labels of one table: one scan, one aggregation, one join."""
    return _label(spark, folder, LabelSpec("orders", "count", "orderkey"), LabelSpec("orders", "sum", "totalprice"), LabelSpec("orders", (Op("agg", "count_if(o_totalprice > 100000) as o_large_label"),)))


@query(f"""SELECT c_custkey, a.n AS o_n, b.n AS l_n_sum FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY o_custkey) a ON c_custkey = a.o_custkey
  LEFT JOIN (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_shipdate > TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
    WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY o_custkey) b ON c_custkey = b.o_custkey""")
def window_of_a_table(spark, folder):
    """A table with a window of its own; the others have the graph's."""
    own = Window(datetime(1999, 1, 1), (365, "day"))
    o = replace(orders(folder, reduce=(Op("agg", "count(*) as o_n"), Op("agg", "sum(l_n) as l_n_sum"))), window=own)
    line = lineitem(folder, reduce=(Op("agg", "count(*) as l_n"),))
    return run(spark, (customer(folder), o, line), (CO, Edge("orders", "lineitem", "orderkey", "orderkey"))).select("c_custkey", "o_n", "l_n_sum")


@query(_auto_sql("count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 90 DAY) AS o_num_events_90d"))
def time_series_told(spark, folder):
    """Whether a table is a series of events is told from its keys and rows."""
    o = replace(orders(folder), time_series="auto")
    df = run(spark, (customer(folder), o), (CO,), policy=FeaturePolicy(functions={"identifier": ("count",)}, lookbacks=(90,), ratios=False, recency=False))
    return df.select("c_custkey", "o_num_events_90d")


@query("SELECT o_orderkey, o_orderdate AS at FROM orders WHERE o_orderkey % 7 <> 0")
def clean_times_of_texts(spark, folder):
    """Texts as times; rows whose text is none are left out."""
    o = spark.read.parquet(f"{folder}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 14 == 0, F.lit("no date")).when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderdate").cast("string"))
    return clean_times(o.select("o_orderkey", text.alias("at")), "at")[0]


@query("SELECT round(100.0 * count(*) FILTER (WHERE o_orderkey % 7 = 0) / count(*), 6) AS percent FROM orders")
def clean_times_share(spark, folder):
    o = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderdate").cast("string")).alias("at"))
    return o.agg(clean_times(o, "at")[1]).select(F.round("percent_removed", 6).alias("percent"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS midnight, epoch_us(date_trunc('day', o_orderdate)) // 1000000 AS seconds FROM orders""")
def scalar_to_date(spark, folder):
    texts = "o_orderkey, to_date(date_format(o_orderdate, 'dd/MM/yyyy'), 'dd/MM/yyyy') as day, to_timestamp_ntz(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd') as midnight, unix_timestamp(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd') as seconds"
    return compile_ops(spark.read.parquet(f"{folder}/orders.parquet"), (Op("select", texts),))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey FROM orders QUALIFY place <= 100")
def ordered_top_rows(spark, folder):
    """Order and limit: the hundred largest orders, each with its place in the order in which they come."""
    top = compile_ops(spark.read.parquet(f"{folder}/orders.parquet"), (Op("order", "o_totalprice desc, o_orderkey"), Op("select", "o_orderkey")))
    first = sample(top, 100)
    return spark.createDataFrame([(i, r[0]) for i, r in enumerate(first.collect(), 1)], "place bigint, o_orderkey bigint")


@query("SELECT label AS y_label, i AS place, round(arg_min(embedding[i], vec_id), 5) AS value FROM embeddings, (SELECT unnest(range(1, (SELECT max(len(embedding)) + 1 FROM embeddings))) AS i) p GROUP BY label, i")
def auto_embedding_whole(spark, folder):
    """The first vector of each group, all of its elements."""
    labels = Table("labels", Source(fn=lambda s: s.read.parquet(f"{folder}/embeddings.parquet").select("label").distinct()), "y", "label")
    vectors = Table("embeddings", Source(path=f"{folder}/embeddings.parquet"), "e", "vec_id")
    df = run(spark, (labels, vectors), (Edge("labels", "embeddings", "label", "label"),), "labels", policy=NO_TIME)
    return df.select("y_label", F.posexplode("e_embedding_first").alias("p", "v")).select("y_label", (F.col("p") + 1).cast("bigint").alias("place"), F.round("v", 5).alias("value"))


@query(_auto_sql("count(DISTINCT o_orderpriority) AS o_orderpriority_nunique, quantile_disc(CAST(o_totalprice AS DOUBLE), 0.5) AS o_totalprice_median"))
def approx_policies(spark, folder):
    """Approximate median and distinct count; for groups as small as these both are exact (the lower of two middle values)."""
    policy = FeaturePolicy(functions={"numerical": ("median",), "categorical": ("nunique",)}, counts=False, ratios=False, recency=False, median="approx", distinct="approx")
    df = _auto(spark, folder, ("orderkey", "custkey", "totalprice", "orderpriority", "orderdate"), ["o_orderpriority_nunique", "o_totalprice_median"], policy=policy)
    return df


# --- the graph ------------------------------------------------------------------------------------------------------------


def _walked(folder: str) -> EntityGraph:
    """The six tables of the reference's domain, with countries' worth of parents left out: they are not here."""
    tables, edges = _domain(folder, ("orders", "products", "notifications", "interactions", "types"))
    return EntityGraph(tables, edges, "cust", Window(datetime(2024, 1, 1)))


@query("""SELECT * FROM (VALUES ('below cust', 'orders', 1), ('below cust', 'products', 2), ('below cust', 'notifications', 1), ('below cust', 'interactions', 2), ('below cust', 'types', 3),
  ('above types', 'cust', 1), ('above types', 'notifications', 2), ('above types', 'interactions', 3)) v(walk, name, place)""")
def graph_walks(spark, folder):
    """What lies below a table, with its distance, and above one, level by level from the farthest."""
    g, depth, rows = _walked(folder), {"cust": 0}, []
    for e in g.descendants("cust"):
        depth[e.child] = depth[e.parent] + 1
        rows.append(("below cust", e.child, depth[e.child]))
    rows += [("above types", n, i) for i, names in enumerate(g.levels_up("types"), 1) for n in names]
    return spark.createDataFrame(rows, "walk string, name string, place int")


@query("""SELECT * FROM (VALUES ('keyword in a fragment', TRUE), ('unknown kind of fragment', TRUE), ('nothing to aggregate', TRUE), ('name on both sides', TRUE), ('unknown table of an edge', TRUE), ('unknown relation', TRUE), ('peer relation', FALSE), ('time without horizon', TRUE)) v(mistake, told)""")
def mistakes_are_told(spark, folder):
    """Which mistakes in a spec are errors."""
    c, o = customer(folder), orders(folder)
    policy = FeaturePolicy(enabled=False)
    cases = {
        "keyword in a fragment": lambda: Op("where", "where a > 1"),
        "unknown kind of fragment": lambda: Op("from", "a"),
        "nothing to aggregate": lambda: run(spark, (c, o), (CO,), policy=policy),
        "name on both sides": lambda: left_join(spark.range(1), spark.range(1), "id", "id"),
        "unknown table of an edge": lambda: EntityGraph((c,), (CO,), "customer", WINDOW),
        "unknown relation": lambda: Edge("a", "b", "k", "k", relation="cousin"),
        "peer relation": lambda: Edge("a", "b", "k", "k", relation="peer"),
        "time without horizon": lambda: EntityGraph((c, o), (CO,), "customer", Window(CUT), labels=(LabelSpec("orders", "sum", "totalprice"),)),
    }

    def told(f: Callable) -> bool:
        try:
            f()
        except (ValueError, TypeError):
            return True
        return False

    return spark.createDataFrame([(name, told(f)) for name, f in cases.items()], "mistake string, told boolean")


@query("""WITH w AS (SELECT TIMESTAMP '2023-01-01' AS a, TIMESTAMP '2024-01-01' AS b),
  o AS (SELECT id, any_value(customer_id) AS customer_id, any_value(amount) AS amount, min(loaded_at) AS l FROM cust_orders GROUP BY id),
  p AS (SELECT id, any_value(order_id) AS order_id, min(loaded_at) AS l FROM order_products GROUP BY id),
  n AS (SELECT id, any_value(customer_id) AS customer_id, min(loaded_at) AS l FROM notifications GROUP BY id),
  i AS (SELECT id, any_value(notification_id) AS notification_id, any_value(interaction_type_id) AS t, min(loaded_at) AS l FROM notification_interactions GROUP BY id),
  tt AS (SELECT id, count(name) AS v FROM notification_interaction_types GROUP BY id),
  pp AS (SELECT order_id, count(id) AS v FROM p, w WHERE l > a AND l < b GROUP BY order_id),
  ii AS (SELECT notification_id, count(i.id) AS v, CAST(sum(tt.v) AS BIGINT) AS ts, max(tt.v) AS tm FROM w, i LEFT JOIN tt ON tt.id = i.t WHERE l > a AND l < b GROUP BY notification_id),
  oo AS (SELECT customer_id, count(o.id) AS or_n, CAST(sum(amount) AS BIGINT) AS or_amount_sum, CAST(sum(pp.v) AS BIGINT) AS op_n_sum FROM w, o LEFT JOIN pp ON pp.order_id = o.id WHERE l > a AND l < b GROUP BY customer_id),
  nn AS (SELECT customer_id, count(n.id) AS no_n, CAST(sum(ii.v) AS BIGINT) AS ni_n_sum, CAST(sum(ts) AS BIGINT) AS ty_n_sum_sum, max(tm) AS ty_n_max_max FROM w, n LEFT JOIN ii ON ii.notification_id = n.id WHERE l > a AND l < b GROUP BY customer_id)
  SELECT c.id AS cu_id, or_n, or_amount_sum, op_n_sum, no_n, ni_n_sum, ty_n_sum_sum, ty_n_max_max FROM (SELECT DISTINCT id FROM cust) c LEFT JOIN oo ON oo.customer_id = c.id LEFT JOIN nn ON nn.customer_id = c.id""")
def cust_six_tables(spark, folder):
    """The whole graph of the reference's main example, to its third level."""
    g = _walked(folder)
    policy = FeaturePolicy(functions={"numerical": ("sum", "max"), "identifier": ("count",)}, counts=False, ratios=False, recency=False, hop_functions=("sum", "max"))
    df = plan(replace(g, policy=policy)).run(spark)
    return df.select("cu_id", "or_n", "or_amount_sum", "op_n_sum", "no_n", "ni_n_sum", "ty_n_sum_sum", "ty_n_max_max")


# --- fractions ------------------------------------------------------------------------------------------------------------



@query(f"SELECT o_custkey, count(*) AS n, CAST(sum({PRICE}) AS DECIMAL(38,2)) AS sum_value, min({PRICE}) AS min_value, max({PRICE}) AS max_value FROM orders GROUP BY o_custkey")
def per_key_fractions(spark, folder):
    """Exact chunking over amounts with fractions."""
    o = spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return per_key_results(o, ["o_custkey"], value="price").select("o_custkey", "n", "sum_value", "min_value", "max_value")


@query(f"""WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum({PRICE}) AS s FROM orders GROUP BY ALL),
  days AS (SELECT o_orderpriority, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY o_orderpriority)
  SELECT o_orderpriority, day, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS n_30d, CAST(sum(s) OVER w AS DECIMAL(38,2)) AS sum_30d FROM days LEFT JOIN d USING (o_orderpriority, day) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_fractions(spark, folder):
    """Rolling totals of amounts with fractions."""
    o = spark.read.parquet(f"{folder}/orders.parquet")
    o = o.select("o_orderpriority", F.unix_date(F.col("o_orderdate").cast("date")).alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return rolling_totals(o, "o_orderpriority", "d", "price", (30,)).select("o_orderpriority", "day", "n_30d", "sum_30d")


@query(f"SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND {AFTER} GROUP BY c_custkey")
def checkpointed_steps(spark, folder):
    """A step cut off by a checkpoint, and the result read from it."""
    c = customer(folder, after_join_reduce=(Op("key", "c_custkey"), Op("agg", "count(o_orderkey) as n")))
    kept = replace(orders(folder), annotate=(Hook(fn=lambda df: df.filter(F.expr(AFTER.replace("TIMESTAMP", "timestamp_ntz"))), checkpoint=True),))
    df = run(spark, (c, kept), (Edge("customer", "orders", "custkey", "custkey", reduce=False, reduce_after_join=True, windowed=False),))
    return checkpoint(df)


