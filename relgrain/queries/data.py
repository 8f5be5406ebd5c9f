"""Queries pN_... of the general problems, each over its whole tables with production parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import ABBREVIATIONS, NORMAL, micros_text, normalize_instants
from ..operators.bitsliced import entity_features
from ..operators.orphans import Reference, apply_deltas, change_deltas, current_orphans, orphan_rows, orphans_of_state
from ..operators.rolling import rolling_totals
from ..operators.skew import heavy_keys, per_key_results
from ..session import checkpoint, looked_up
from ..sources.records import records, table

CUT = dt.datetime(2024, 4, 1, tzinfo=dt.UTC)
CUT_US = int(CUT.timestamp()) * 1_000_000
#: The end of the tables' span.
END_US = int(dt.datetime(2024, 7, 1, tzinfo=dt.UTC).timestamp()) * 1_000_000


def systems(spark: SparkSession, folder: str) -> DataFrame:
    """``source_system, time_zone, date_order``, one row a system."""
    df = table(spark, folder, "source_systems").filter(F.col("source_system").isNotNull())
    return df.groupBy("source_system").agg(F.max("time_zone").alias("time_zone"), F.max("date_order").alias("date_order"))


def with_instants(spark: SparkSession, folder: str, df: DataFrame, text: str) -> DataFrame:
    return normalize_instants(looked_up(df, systems(spark, folder), "source_system", "left"), text, "time_zone", "date_order")


# --- p1 ---------------------------------------------------------------------------------------------------------------


def p1_rolling(spark: SparkSession, folder: str) -> DataFrame:
    orders = records(table(spark, folder, "cust_orders"), {c: c for c in ("customer_id", "ts", "amount", "source_system")}, loaded=None)
    at = with_instants(spark, folder, orders.filter("customer_id is not null and ts is not null"), "ts")
    return rolling_totals(at.withColumn("day", F.expr("floor(instant_us / 86400000000D)").cast("int")), "customer_id", "day", "amount", (7, 30))


# --- p2 ---------------------------------------------------------------------------------------------------------------


def _by_customer(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "cust_orders").select(F.lit("cust_orders").alias("table_name"), "customer_id", "loaded_at", "amount")
    notes = table(spark, folder, "notifications").select(F.lit("notifications").alias("table_name"), "customer_id", "loaded_at", F.lit(None).cast("bigint").alias("amount"))
    return orders.unionByName(notes)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(_by_customer(spark, folder), "table_name", "customer_id", 0.03).select("table_name", "customer_id")


def p2_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    out = per_key_results(_by_customer(spark, folder), ["table_name", "customer_id"], order="loaded_at", value="amount")
    return out.filter("customer_id is not null").drop("chunks")


# --- p3 ---------------------------------------------------------------------------------------------------------------


def interaction_events(spark: SparkSession, folder: str, cut_us: int = CUT_US, undated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events per notification and type, with the customer; and the customers that notifications name.

    The total of an event is the whole minutes from its time to its arrival, none where it arrived before.
    Events of one notification and type are combined before the join, so a notification with any share of the
    interactions is a row per type. With ``undated`` interactions without time are events too, of no total.
    """
    deeds = table(spark, folder, "notification_interactions").filter("notification_id is not null and interaction_type_id is not null")
    deeds = deeds if undated else deeds.filter("ts is not null")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    deeds = records(deeds, {"nid": "notification_id", "type": "interaction_type_id", "at": us("ts")}).filter(F.col("at").isNull() | (F.col("at") < cut_us))
    late = F.greatest(F.lit(0), F.coalesce(F.expr("unix_micros(cast(loaded_at as timestamp)) - at"), F.lit(0)))
    deeds = deeds.groupBy("nid", "type").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.sum(F.floor(late / 60_000_000)).cast("bigint").alias("total"))
    notes = records(table(spark, folder, "notifications").filter("id is not null and customer_id is not null"), {"customer_id": "customer_id"}, loaded=None)
    joined = notes.withColumnRenamed("id", "nid").join(deeds, "nid").select(F.col("customer_id").cast("bigint").alias("entity"), F.col("type").cast("bigint").alias("type"), "n", "at", "total")
    return joined, table(spark, folder, "notifications").select("customer_id")


def _entity_features(spark: SparkSession, folder: str, cut_us: int, undated: bool) -> DataFrame:
    events, customers = interaction_events(spark, folder, cut_us, undated)
    used = table(spark, folder, "notification_interactions").select("interaction_type_id")
    types = table(spark, folder, "notification_interaction_types").select("id").union(used)
    return entity_features(events, customers, types, "customer_id", cut_us, undated=undated)


def p3_features(spark: SparkSession, folder: str) -> DataFrame:
    return _entity_features(spark, folder, CUT_US, undated=False)


def p3_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p3_features``, with the interactions without time and those up to the end of the tables' span."""
    return _entity_features(spark, folder, END_US, undated=True)


# --- p4 ---------------------------------------------------------------------------------------------------------------


def references(spark: SparkSession, folder: str, copies: bool = False) -> list[Reference]:
    """The four references; the earliest-loaded copy of an id stands for it. With ``copies`` child records are as they
    are stored, which spares a shuffle of them all where only few are looked for."""
    children = (("order_products", "order_id", False), ("notification_interactions", "notification_id", False), ("cust_orders", "customer_id", True), ("notifications", "customer_id", True))

    def child(name: str, key: str, deleted: bool) -> DataFrame:
        stored = table(spark, folder, name)
        gone = F.col("deleted_at") if deleted else F.lit(None).cast("timestamp_ntz")
        if copies:
            return stored.select(F.col("id").alias("row_id"), F.col(key).alias("key"), F.col("loaded_at").alias("at"), gone.alias("gone"))
        once = records(stored, {"key": key} | ({"gone": "deleted_at"} if deleted else {}))
        return once.select(F.col("id").alias("row_id"), "key", F.col("loaded_at").alias("at"), ("gone" if deleted else gone.alias("gone")))

    def parent(name: str) -> DataFrame:
        # By the id alone, so that what is counted per key afterwards needs no other shuffle.
        stored = table(spark, folder, name).filter("id is not null").groupBy(F.col("id").alias("key"))
        return stored.agg(F.min("loaded_at").alias("at"), F.max("deleted_at").alias("gone"))

    orders, notes, customers = parent("cust_orders"), parent("notifications"), parent("cust")
    return [Reference(c[0], child(*c), p, copies) for c, p in zip(children, (orders, notes, customers, customers))]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_rows(references(spark, folder, copies=True)).select("table_name", "row_id", "kind")


def p4_by_month(spark: SparkSession, folder: str) -> DataFrame:
    rows = orphan_rows(references(spark, folder, copies=True))
    return rows.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month"), "kind").agg(F.count("*").alias("n"))


def p4_current(spark: SparkSession, folder: str) -> DataFrame:
    return current_orphans(references(spark, folder))


def p4_maintained(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p4_current``, from a state that is kept: what happened until the middle of the span is applied first and
    written, what came later, or has no time, is applied to that."""
    deltas = change_deltas(references(spark, folder))
    early = F.coalesce(F.col("at") < F.lit("2023-04-01").cast("timestamp_ntz"), F.lit(False))
    return orphans_of_state(apply_deltas(deltas.filter(~early), checkpoint(apply_deltas(deltas.filter(early)))))


# --- p5 ---------------------------------------------------------------------------------------------------------------


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the three tables: ``table_name, row_id, ts, instant_us, instant_reason``."""
    parts = []
    for name, key, text in (("cust_orders", "id", "ts"), ("notifications", "id", "ts"), ("city", "city_id", "last_update")):
        rows = records(table(spark, folder, name), {"ts": text, "source_system": "source_system"}, key=key, loaded=None)
        parts.append(rows.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_id"), "ts", "source_system"))
    return with_instants(spark, folder, parts[0].unionByName(parts[1]).unionByName(parts[2]), "ts")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalized(spark, folder).filter(F.col("ts").isNotNull() & ~F.col("ts").rlike(NORMAL))
    return rows.select("table_name", "row_id", F.coalesce("instant_reason", micros_text(F.col("instant_us"))).alias("outcome"))


def p5_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How many records of each table and source system came to what."""
    told = F.when(F.col("ts").isNull(), "null").otherwise(F.coalesce("instant_reason", F.lit("instant")))
    return normalized(spark, folder).groupBy("table_name", "source_system", told.alias("outcome")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_rolling, p2_found, p2_per_customer, p3_features, p3_whole, p4_found, p4_by_month, p4_current, p4_maintained, p5_found, p5_outcomes)}

_REFS = """
  WITH c AS (
    SELECT 'order_products' AS table_name, id, any_value(order_id) AS key, min(loaded_at) AS seen_us, CAST(NULL AS TIMESTAMP) AS gone FROM order_products GROUP BY id
    UNION ALL SELECT 'notification_interactions', id, any_value(notification_id), min(loaded_at), NULL FROM notification_interactions GROUP BY id
    UNION ALL SELECT 'cust_orders', id, any_value(customer_id), min(loaded_at), any_value(deleted_at) FROM cust_orders GROUP BY id
    UNION ALL SELECT 'notifications', id, any_value(customer_id), min(loaded_at), any_value(deleted_at) FROM notifications GROUP BY id),
  p AS (
    SELECT 'order_products' AS table_name, id AS key, min(loaded_at) AS born, any_value(deleted_at) AS died FROM cust_orders GROUP BY id
    UNION ALL SELECT 'notification_interactions', id, min(loaded_at), any_value(deleted_at) FROM notifications GROUP BY id
    UNION ALL SELECT 'cust_orders', id, min(loaded_at), any_value(deleted_at) FROM cust GROUP BY id
    UNION ALL SELECT 'notifications', id, min(loaded_at), any_value(deleted_at) FROM cust GROUP BY id),
  k AS (
    SELECT c.table_name, c.id AS row_id, c.seen_us,
      CASE WHEN p.key IS NULL THEN 'missing' WHEN p.born > c.seen_us THEN 'late' WHEN p.died <= c.seen_us THEN 'deleted' END AS kind
    FROM c LEFT JOIN p USING (table_name, key) WHERE c.key IS NOT NULL)
"""
_UNION = """(SELECT 'cust_orders' AS table_name, customer_id, loaded_at, amount FROM cust_orders
  UNION ALL SELECT 'notifications', customer_id, loaded_at, NULL FROM notifications)"""



def _features_sql(cut_us: int, counted: str) -> str:
    return f"""WITH d AS (SELECT id, any_value(notification_id) AS nid, any_value(interaction_type_id) AS type, any_value(ts) AS ts, min(loaded_at) AS loaded_at FROM notification_interactions GROUP BY id),
  n AS (SELECT id AS nid, any_value(customer_id) AS customer_id FROM notifications GROUP BY id),
  e AS (SELECT customer_id, type, count(*) AS n, max(epoch_us(ts)) AS seen_us, CAST(coalesce(sum(greatest(0, epoch_us(loaded_at) - epoch_us(ts)) // 60000000) FILTER (WHERE ts IS NOT NULL), 0) AS BIGINT) AS total
    FROM d JOIN n USING (nid) WHERE type IS NOT NULL AND customer_id IS NOT NULL AND {counted} GROUP BY customer_id, type),
  axis AS (SELECT id AS type FROM notification_interaction_types WHERE id IS NOT NULL UNION SELECT type FROM d WHERE type IS NOT NULL),
  who AS (SELECT DISTINCT customer_id FROM notifications WHERE customer_id IS NOT NULL)
  SELECT customer_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_events, count(n) AS n_types, list(type ORDER BY type) AS types, list(coalesce(n, 0) ORDER BY type) AS counts,
    list(({cut_us} - seen_us) // 1000000 ORDER BY type) AS recency_s, list(coalesce(total, 0) ORDER BY type) AS totals
  FROM who CROSS JOIN axis LEFT JOIN e USING (customer_id, type) GROUP BY customer_id"""


SQL = {
    "p2_found": f"""SELECT table_name, customer_id FROM (
  SELECT table_name, customer_id, n, sum(n) OVER (PARTITION BY table_name) AS total FROM (SELECT table_name, customer_id, count(*) AS n FROM {_UNION} GROUP BY table_name, customer_id))
  WHERE customer_id IS NOT NULL AND n * 100 >= total * 3""",
    "p2_per_customer": f"""WITH r AS (SELECT *, epoch_us(loaded_at) AS o, epoch_us(loaded_at) - lag(epoch_us(loaded_at)) OVER (PARTITION BY table_name, customer_id ORDER BY loaded_at NULLS FIRST) AS gap FROM {_UNION} WHERE customer_id IS NOT NULL)
  SELECT table_name, customer_id, count(*) AS n, count(amount) AS n_value, CAST(sum(amount) AS DECIMAL(38,0)) AS sum_value, min(amount) AS min_value, max(amount) AS max_value,
    min(o) AS first_order, max(o) AS last_order, max(gap) AS max_gap FROM r GROUP BY table_name, customer_id""",
    "p3_features": _features_sql(CUT_US, f"epoch_us(ts) < {CUT_US}"),
    "p3_whole": _features_sql(END_US, f"(ts IS NULL OR epoch_us(ts) < {END_US})"),
    "p4_found": _REFS + "SELECT table_name, row_id, kind FROM k WHERE kind IS NOT NULL",
    "p4_by_month": _REFS + "SELECT table_name, strftime(seen_us, '%Y-%m') AS month, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY table_name, month, kind",
    "p4_current": _REFS + """SELECT c.table_name, c.key, CAST(sum(CASE WHEN c.gone IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS refs,
    CAST(max(CASE WHEN p.key IS NULL THEN 0 WHEN p.died IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "exists", CASE WHEN max(p.key) IS NULL THEN 'missing' ELSE 'deleted' END AS kind
  FROM c LEFT JOIN p USING (table_name, key) WHERE c.key IS NOT NULL GROUP BY c.table_name, c.key
  HAVING sum(CASE WHEN c.gone IS NULL THEN 1 ELSE 0 END) > 0 AND max(CASE WHEN p.key IS NULL THEN 0 WHEN p.died IS NULL THEN 1 ELSE 0 END) = 0""",
}

SQL["p4_maintained"] = SQL["p4_current"]
#: The texts parsed another way, by strptime formats and the zone rules of ICU, for the tables' own formats.
_MINUTES = ", ".join(f"('{a}', {m})" for a, m in ABBREVIATIONS.items())
_INSTANTS = r"""
  WITH raw AS (
    SELECT DISTINCT 'cust_orders' AS table_name, id AS row_id, ts, source_system, customer_id, amount FROM cust_orders
    UNION ALL SELECT DISTINCT 'notifications', id, ts, source_system, NULL, NULL FROM notifications
    UNION ALL SELECT DISTINCT 'city', city_id, last_update, source_system, NULL, NULL FROM city),
  abbreviations(abbr, minutes) AS (VALUES """ + _MINUTES + r"""),
  cleaned AS (
    SELECT raw.*, time_zone, coalesce(date_order, '') AS date_order, trim(regexp_replace(ts, '[\s\pZ\x{200B}-\x{200D}\x{2060}\x{FEFF}]', ' ', 'g')) AS s
    FROM raw LEFT JOIN source_systems USING (source_system)),
  zoned AS (
    SELECT *, regexp_extract(s, '(?:\d:\d\d(?::\d\d)?(?:[.,]\d+)?|T\d{6})\s*([+-]\d\d:?(?:\d\d)?)(?:\[.*\])?$', 1) AS off,
      regexp_extract(s, '\s([A-Za-z]+/[A-Za-z_/]+)$', 1) AS region,
      CASE WHEN upper(regexp_extract(s, '\d\s*([A-Za-z]{1,5})$', 1)) IN ('AM', 'PM') THEN '' ELSE upper(regexp_extract(s, '\d\s*([A-Za-z]{1,5})$', 1)) END AS abbr FROM cleaned),
  locals AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      CASE WHEN off <> '' OR region <> '' OR abbr <> '' THEN regexp_replace(s, '(\s*[+-]\d\d:?(\d\d)?(\[.*\])?|\s+[A-Za-z]+/[A-Za-z_/]+|\s*[A-Za-z]{1,5})$', '') ELSE s END,
      '(\d)[Tt](\d)', '\1 \2'), ',(\d+)$', '.\1'), '(\.\d{6})\d+$', '\1'), '^[A-Za-z]{3}, ', '') AS l FROM zoned),
  parsed AS (
    SELECT *, CASE WHEN regexp_matches(s, '^\d{10}(\.\d+)?$') THEN CAST(CAST(s AS DECIMAL(30,6)) * 1000000 AS BIGINT) WHEN regexp_matches(s, '^\d{13}$') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_matches(s, '^\d{16}$') THEN CAST(s AS BIGINT) END AS epoch,
      CASE WHEN regexp_matches(l, '^\d{4}-') THEN try_strptime(l, ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d'])
        WHEN regexp_matches(l, '^\d{8}$') THEN try_strptime(l, '%Y%m%d') WHEN regexp_matches(l, '^\d{14}$') THEN try_strptime(l, '%Y%m%d%H%M%S') WHEN regexp_matches(l, '^\d{8} \d{6}$') THEN try_strptime(l, '%Y%m%d %H%M%S')
        WHEN regexp_matches(l, '^\d{1,2}[/.]\d{1,2}[/.]\d{2}( |$)') AND date_order = 'MDY' THEN try_strptime(replace(l, '.', '/'), '%m/%d/%y %H:%M')
        WHEN regexp_matches(l, '^\d{1,2}[/.]\d{1,2}[/.]\d{2}( |$)') AND date_order = 'DMY' THEN try_strptime(replace(l, '.', '/'), '%d/%m/%y %H:%M')
        WHEN regexp_matches(l, '^\d{1,2}[/.]\d{1,2}[/.]\d{2}( |$)') THEN try_strptime(replace(l, '.', '/'), '%y/%m/%d %H:%M')
        WHEN regexp_matches(l, '^\d{1,2}[/.]\d') AND date_order = 'MDY' THEN try_strptime(upper(replace(l, '.', '/')), ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M', '%m/%d/%Y'])
        WHEN regexp_matches(l, '^\d{1,2}[/.]\d') THEN try_strptime(upper(replace(l, '.', '/')), ['%d/%m/%Y %I:%M:%S %p', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y'])
        WHEN regexp_matches(l, '^\d{1,2} [A-Z]') THEN try_strptime(l, ['%d %b %Y %H:%M:%S', '%d %B %Y %H:%M'])
        WHEN regexp_matches(l, '^[A-Z][a-z]+ \d') THEN try_strptime(l, '%B %d, %Y %I:%M %p') END AS local FROM locals),
  known AS (
    SELECT parsed.*, CASE WHEN off <> '' THEN (CASE off[1] WHEN '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS INTEGER) * 60 + coalesce(TRY_CAST(replace(off[4:], ':', '') AS INTEGER), 0)) ELSE minutes END AS fixed,
      CASE WHEN off = '' AND minutes IS NULL THEN coalesce(nullif(region, ''), CASE WHEN abbr = '' THEN time_zone END) END AS zone FROM parsed LEFT JOIN abbreviations USING (abbr)),
  tried AS (
    SELECT *, CASE WHEN zone IS NOT NULL AND local IS NOT NULL THEN list_sort(list_distinct([x FOR x IN [epoch_us(timezone(zone, local)) + d * 900000000 FOR d IN generate_series(-8, 8)] IF timezone(zone, make_timestamptz(x)) = local])) END AS at_zone FROM known),
  done AS (
    SELECT *, CASE WHEN ts IS NULL THEN NULL WHEN epoch IS NULL AND local IS NULL THEN 'invalid' WHEN epoch IS NOT NULL OR fixed IS NOT NULL THEN NULL WHEN zone IS NULL THEN 'no_zone'
        WHEN NOT regexp_matches(l, '^[\d/.-]{8,10}$') AND len(at_zone) = 0 THEN 'nonexistent' WHEN NOT regexp_matches(l, '^[\d/.-]{8,10}$') AND len(at_zone) > 1 THEN 'ambiguous' END AS reason,
      CASE WHEN epoch IS NOT NULL THEN epoch WHEN fixed IS NOT NULL THEN epoch_us(local) - CAST(fixed AS BIGINT) * 60000000 ELSE at_zone[1] END AS us FROM tried)
"""
SQL["p5_found"] = _INSTANTS + r"""SELECT table_name, row_id, coalesce(reason, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ')) AS outcome FROM done
  WHERE ts IS NOT NULL AND NOT regexp_full_match(ts, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z')"""
SQL["p5_outcomes"] = _INSTANTS + """SELECT table_name, source_system, CASE WHEN ts IS NULL THEN 'null' ELSE coalesce(reason, 'instant') END AS outcome, count(*) AS n FROM done GROUP BY ALL"""
SQL["p1_rolling"] = _INSTANTS + """, daily AS (SELECT customer_id, CAST(make_timestamp(us) AS DATE) AS day, count(*) AS n, count(amount) AS k, sum(amount) AS s FROM done
    WHERE table_name = 'cust_orders' AND customer_id IS NOT NULL AND us IS NOT NULL AND reason IS NULL GROUP BY customer_id, day),
  days AS (SELECT customer_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY customer_id),
  w AS (SELECT customer_id, day, sum(coalesce(n, 0)) OVER a AS n7, sum(k) OVER a AS k7, sum(s) OVER a AS s7, sum(coalesce(n, 0)) OVER b AS n30, sum(k) OVER b AS k30, sum(s) OVER b AS s30 FROM days LEFT JOIN daily USING (customer_id, day)
    WINDOW a AS (PARTITION BY customer_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), b AS (PARTITION BY customer_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
  SELECT customer_id, day, CAST(n7 AS BIGINT) AS n_7d, CAST(s7 AS DECIMAL(38,0)) AS sum_7d, CAST(s7 AS DOUBLE) / nullif(k7, 0) AS avg_7d, CAST(n30 AS BIGINT) AS n_30d, CAST(s30 AS DECIMAL(38,0)) AS sum_30d, CAST(s30 AS DOUBLE) / nullif(k30, 0) AS avg_30d FROM w"""
