"""Registered queries: scans, source mapping, merge sources, customer attributes, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import SHOP, WEB, profiles as profiles_sql, with_
from patronlens.functions.columns import apply_rule, mobile_substring, numeric_text, r6
from patronlens.operators import identity
from patronlens.plans.inputs import web_profiles, web_resolved
from patronlens.plans.profile_queries import stamp
from patronlens.functions.lineage import shared_folder
from patronlens.plans.registry import query
from patronlens.sources import mapping, retail, sampling, sinks, tables

# Table names used to exercise the name mapping.
_NAMES = ("purchase", "orders", "search", "session_end", "page_visit", "cart_update", "refund", "misc", "Line_Item", "pdp_view")


def _array_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case_sql(column: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{default}' END"


@query("source_table_event_types", f"""
SELECT t AS table_name, kind AS canonical_type,
  {_case_sql('kind', mapping.CANONICAL_TYPES, 'view_item')} AS event_type,
  {_case_sql('t', mapping.FOLDER_TABLE_TYPES, 'view_item')} AS folder_type, count(*) AS n_rows
FROM (SELECT t, {_case_sql('lower(t)', mapping.TABLE_TYPES, 'custom')} AS kind
      FROM (SELECT {_array_sql(_NAMES)}[event_id % {len(_NAMES)} + 1] AS t FROM events)) GROUP BY ALL""")
def source_table_event_types(spark, folder):
    names = F.array(*[F.lit(n) for n in _NAMES])
    rows = retail.table(spark, folder, "events").select(
        F.element_at(names, (F.col("event_id") % len(_NAMES) + 1).cast("int")).alias("table_name"))
    return rows.groupBy("table_name").agg(F.count("*").alias("n_rows")).select(
        "table_name", mapping.canonical_type(F.col("table_name")).alias("canonical_type"),
        mapping.event_type_of_table(F.col("table_name")).alias("event_type"),
        mapping.folder_event_type(F.col("table_name")).alias("folder_type"), "n_rows")


def _raw_rows(spark, folder):
    """The click log in the shape of an export: text times, a property map, gaps and bad values."""
    log = retail.table(spark, folder, "events")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.from_json("props", "k INT")["k"]
    n = F.col("event_id")
    properties = F.map_from_entries(F.array(
        F.struct(F.lit("item_id"), F.concat(F.lit("p"), k.cast("string"))),
        F.struct(F.lit("sku"), F.lit("unused")),
        F.struct(F.lit("name"), F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("item "), k.cast("string")))),
        F.struct(F.lit("price"), F.when(n % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))),
        F.struct(F.lit("qty"), F.when(n % 5 == 0, F.lit("many")).otherwise(F.concat((n % 4).cast("string"), F.lit(".0")))),
        F.struct(F.lit("device"), F.when(n % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("Mobile Web"))),
        F.struct(F.lit("platform"), F.lit("desktop")),
        F.struct(F.lit("category"), F.when(n % 2 == 0, F.concat(F.lit("c"), (k % 5).cast("string")))),
        F.struct(F.lit("subcategory"), F.concat(F.lit("s"), (k % 20).cast("string"))),
        F.struct(F.lit("amount"), F.when(n % 6 == 0, F.col("value").cast("decimal(18,2)").cast("string"))),
        F.struct(F.lit("colour"), F.when(n % 3 == 1, F.concat(F.lit("tone"), (k % 3).cast("string")))),
        F.struct(F.lit("finish"), F.when(n % 9 == 0, F.lit("matte"))),
    ))
    return log.select(
        F.when(n % 50 == 0, F.lit(None).cast("string")).when(n % 50 == 1, F.lit("")).otherwise(F.col("user_id").cast("string"))
        .alias("internal_customer_id"),
        F.when(n % 60 == 2, F.lit("not a time")).when(n % 2 == 0, F.concat(at, F.lit("Z"))).otherwise(at).alias("timestamp"),
        properties.alias("properties"), F.col("event_id"), F.col("event_type").alias("event_name"), F.col("value"),
    )


_RAW = """
raw AS (
  SELECT event_id AS n, user_id, ts, CAST(value AS DECIMAL(18,2)) AS price, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
kept AS (SELECT * FROM raw WHERE n % 50 NOT IN (0, 1) AND n % 60 <> 2)
"""


@query("raw_rows_to_events", with_(_RAW, select="""
SELECT CAST(user_id AS VARCHAR) AS customer_id, 'view_item' AS event_type, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts,
  'p' || k AS product_id, CASE WHEN n % 4 <> 0 THEN 'item ' || k END AS product_name,
  CASE WHEN n % 7 <> 0 THEN round(CAST(price AS DOUBLE), 6) END AS product_price,
  CASE WHEN n % 5 <> 0 THEN CAST(n % 4 AS BIGINT) END AS quantity,
  CASE WHEN n % 3 = 0 THEN 'desktop' ELSE 'Mobile Web' END AS device_type,
  CASE WHEN n % 2 = 0 THEN 'c' || (k % 5) END AS product_category, 's' || (k % 20) AS category_level_2,
  CASE WHEN n % 6 = 0 THEN round(CAST(price AS DOUBLE), 6) END AS order_total FROM kept"""))
def raw_rows_to_events(spark, folder):
    rows = mapping.rows_to_events(_raw_rows(spark, folder), "page_visit")
    return rows.select(
        "customer_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "product_id", "product_name",
        r6(F.col("product_price")).alias("product_price"), F.col("quantity").cast("bigint").alias("quantity"), "device_type",
        "product_category", "category_level_2", r6(F.col("order_total")).alias("order_total"))


@query("overflow_properties", with_(_RAW, select="""
SELECT key, value, count(*) AS n_events FROM (
  SELECT 'colour' AS key, 'tone' || (k % 3) AS value FROM kept WHERE n % 3 = 1
  UNION ALL SELECT 'finish', 'matte' FROM kept WHERE n % 9 = 0) GROUP BY 1, 2"""))
def overflow_properties(spark, folder):
    rows = mapping.rows_to_events(_raw_rows(spark, folder), "page_visit")
    return rows.select(F.explode("custom_properties")).groupBy("key", "value").agg(F.count("*").alias("n_events"))


@query("event_ids_are_stable", with_(_RAW, select="SELECT count(*) AS n_events, count(*) AS n_ids FROM kept"))
def event_ids_are_stable(spark, folder):
    rows = mapping.rows_to_events(_raw_rows(spark, folder), "page_visit")
    return rows.agg(F.count("*").alias("n_events"), F.count_distinct("event_id").alias("n_ids"))


@query("source_query_filters", """
SELECT event_id, user_id, round(value, 6) AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND value > 50 AND event_type <> 'error'
ORDER BY ts LIMIT 500""")
def source_query_filters(spark, folder):
    config = mapping.EventTable("events", "view_item", "user_id", "ts", "ts", filters=("value > 50", "event_type <> 'error'"))
    rows = mapping.source_rows(retail.table(spark, folder, "events"), config, "2024-01-05 00:00:00", "2024-01-20 00:00:00", limit=500)
    return rows.select("event_id", "user_id", r6(F.col("value")).alias("value"))


def _orders_export(spark, folder):
    """Orders with a JSON product list, the shape of a purchase table in an export."""
    product = F.struct(
        F.when(F.col("l_linenumber") % 3 != 0, F.col("p_type")).alias("category"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("p_brand")).alias("product_category"))
    # at most seven lines per order
    lists = retail.order_lines(spark, folder).groupBy("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").agg(
        F.to_json(F.collect_list(product)).alias("product_list"))
    return lists.select(
        F.col("o_custkey").cast("string").alias("internal_customer_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.struct(
            F.col("o_orderkey").alias("purchase_id"), F.col("product_list"),
            F.when(F.col("o_orderkey") % 3 == 0, F.lit("tablet")).alias("device"), F.lit("desktop").alias("device_type"),
            F.when(F.col("o_orderkey") % 4 == 0, F.lit("12.50")).when(F.col("o_orderkey") % 4 == 1, F.lit("oops")).alias("shipping"),
            F.col("o_orderpriority").alias("priority"),
        ).alias("properties"))


_PURCHASES = mapping.EventTable("purchase", "purchase", mappings={
    "order_id": mapping.FieldMapping("properties.purchase_id"),
    "product_list": mapping.FieldMapping("properties.product_list"),
    "device": mapping.FieldMapping("properties.device"),
    "device_type": mapping.FieldMapping("properties.device_type"),
    "product_price": mapping.FieldMapping("properties.shipping", "decimal", "1.25"),
    "quantity": mapping.FieldMapping("properties.missing", "int", "1"),
    "priority": mapping.FieldMapping("properties.priority", lambda c: F.upper(F.substring(c, 1, 1))),
}, product_category_field="properties.priority")


@query("configured_projection", with_(SHOP, select="""
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS order_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'tablet' ELSE 'desktop' END AS device_type,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 12.5 WHEN 1 THEN NULL ELSE 1.25 END AS DOUBLE) AS product_price, CAST(1 AS BIGINT) AS quantity,
  o_orderpriority AS product_category, upper(o_orderpriority[1]) AS priority
FROM (SELECT DISTINCT l_orderkey AS o_orderkey, o_custkey, o_orderpriority FROM lines)"""))
def configured_projection(spark, folder):
    rows = mapping.project_events(_orders_export(spark, folder), _PURCHASES)
    return rows.select(
        "customer_id", F.col("order_id").cast("string").alias("order_id"), "device_type",
        r6(F.col("product_price")).alias("product_price"), "quantity", "product_category",
        F.col("custom_properties")["priority"].alias("priority"))


@query("order_category_lists", with_(SHOP, select="""
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, string_agg(c, ',' ORDER BY c) AS categories FROM (
  SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN p_type ELSE p_brand END AS c FROM lines) GROUP BY 1"""))
def order_category_lists(spark, folder):
    rows = mapping.project_events(_orders_export(spark, folder), _PURCHASES)
    names = F.from_json(F.col("custom_properties")["product_categories"], "array<string>")
    return rows.select(F.col("order_id").cast("string").alias("order_id"), F.array_join(names, ",").alias("categories"))


_EXPORTED = {"purchase": "purchase", "session_start": "signup", "view_item": "view"}


@query("folder_event_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS source_table, count(*) AS n_events, count(DISTINCT user_id) AS customers FROM events WHERE event_type = '{kind}'" for name, kind in _EXPORTED.items())
    + " UNION ALL SELECT '(unreadable) clicks', count(*) FILTER (WHERE false), 0 FROM events")
def folder_event_counts(spark, folder):
    """A folder with one table for each kind of event, written from the log, whose columns differ, and one without customers."""
    log, base = retail.table(spark, folder, "events"), shared_folder(spark)
    who, when = F.col("user_id").cast("string").alias("internal_customer_id"), F.col("ts").cast("timestamp").alias("timestamp")
    extra = {"purchase": [F.col("value").alias("price")], "session_start": [], "view_item": [F.get_json_object("props", "$.k").alias("product_id")]}
    for name, kind in _EXPORTED.items():
        log.where(F.col("event_type") == kind).select(who, when, *extra[name]).write.parquet(f"{base}/{name}.parquet")
    log.where("event_type = 'click'").select(when).write.parquet(f"{base}/clicks.parquet")
    loaded, errors = tables.load_events(spark, base, mapping.SourceConfig("folder", "internal_customer_id", "timestamp", None))
    unread = spark.createDataFrame([(f"(unreadable) {name}", 0, 0) for name in errors], "source_table string, n_events bigint, customers bigint")
    return tables.events_per_table(loaded).unionByName(unread)


@query("preset_event_types", """
SELECT 'ga4' AS preset, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'view_item' END AS event_type, count(*) AS n_events,
  round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) AS revenue FROM events GROUP BY 1, 2
UNION ALL
SELECT 'segment', 'purchase', count(*), round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) FROM events
UNION ALL SELECT 'bloomreach', 'view_category', count(*), round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) FROM events
UNION ALL SELECT 'generic', 'view_item', count(*), round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) FROM events""")
def preset_event_types(spark, folder):
    log = retail.table(spark, folder, "events")
    who, when, worth = F.col("user_id"), F.col("ts").cast("timestamp"), F.col("value").cast("decimal(18,2)")
    shaped = {
        "ga4": ("events", log.select(who.alias("user_pseudo_id"), when.alias("event_timestamp"), F.col("event_type").alias("event_name"),
                                     F.struct(worth.alias("value")).alias("event_params"))),
        "segment": ("order_completed", log.select("user_id", when.alias("timestamp"), worth.alias("total"))),
        "bloomreach": ("search", log.select(who.alias("internal_customer_id"), when.alias("timestamp"),
                                            F.struct(worth.alias("total_price")).alias("properties"))),
        "generic": ("anything", log.select(who.alias("customer_id"), when.alias("timestamp"), worth.alias("revenue"))),
    }
    out = None
    for name, (table, frame) in shaped.items():
        rows = mapping.rows_to_events(frame, table, mapping.PRESETS[name]()).select(F.lit(name).alias("preset"), "event_type", "order_total")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("preset", "event_type").agg(F.count("*").alias("n_events"), r6(F.sum("order_total")).alias("revenue"))


def _history_sources(spark, folder):
    """Two merge sources over the shop's customers that overlap on some past ids."""
    buyers = retail.table(spark, folder, "customer").select(F.col("c_custkey").alias("c"))
    table = buyers.where("c % 7 = 1").select(
        F.col("c").cast("string").alias("past_id"), (F.col("c") - 1).cast("string").alias("internal_customer_id"))
    ids = F.array((F.col("c") - 1).cast("string"), F.col("c").cast("string"), (F.col("c") - 2).cast("string"))
    merges = buyers.where("c % 7 = 2").select(
        F.col("c").cast("string").alias("internal_customer_id"),
        F.create_map(F.lit("source_internal_ids"),
                     F.when(F.col("c") % 3 == 0, F.to_json(ids)).when(F.col("c") % 3 == 1, (F.col("c") - 2).cast("string"))
                     .otherwise(F.concat(F.lit("[\""), (F.col("c") - 1).cast("string"), F.lit("\"]")))).alias("properties"))
    return table, merges


_HISTORY = """
hist AS (
  SELECT c_custkey AS past, c_custkey - 1 AS target, 0 AS src FROM customer WHERE c_custkey % 7 = 1
  UNION ALL SELECT c_custkey - 1, c_custkey, 1 FROM customer WHERE c_custkey % 7 = 2 AND c_custkey % 3 IN (0, 2)
  UNION ALL SELECT c_custkey - 2, c_custkey, 1 FROM customer WHERE c_custkey % 7 = 2 AND c_custkey % 3 IN (0, 1))
"""


@query("first_merge_history", with_(_HISTORY, select="""
SELECT CAST(past AS VARCHAR) AS past_id, CAST(target AS VARCHAR) AS internal_customer_id, CAST(src AS BIGINT) AS source_rank
FROM (SELECT *, row_number() OVER (PARTITION BY past ORDER BY src, CAST(target AS VARCHAR)) AS rn FROM hist) WHERE rn = 1"""))
def first_merge_history(spark, folder):
    table, merges = _history_sources(spark, folder)
    rows = tables.first_history(tables.history_rows(table), tables.merge_event_rows(merges))
    return rows.select("past_id", "internal_customer_id", F.col("source_rank").cast("bigint").alias("source_rank"))


@query("merge_event_sources", with_(_HISTORY, select="""
SELECT CAST(past AS VARCHAR) AS past_id, CAST(target AS VARCHAR) AS internal_customer_id FROM hist WHERE src = 1"""))
def merge_event_sources(spark, folder):
    _, merges = _history_sources(spark, folder)
    return tables.merge_event_rows(merges).select("past_id", "internal_customer_id")


@query("configured_merge_table", """
SELECT CAST(c_custkey AS VARCHAR) AS past_id, CAST(c_nationkey AS VARCHAR) AS internal_customer_id
FROM customer WHERE c_custkey % 11 <> 0""")
def configured_merge_table(spark, folder):
    rows = retail.table(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey")).alias("old"), F.col("c_nationkey").alias("now"))
    return tables.configured_history(rows, "old", "now").select("past_id", "internal_customer_id")


@query("customer_attributes", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'u' || c_custkey || '@example.org' AS email, n_name AS country, c_mktsegment AS rfm_segment
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def customer_attributes(spark, folder):
    buyers = retail.table(spark, folder, "customer").join(
        retail.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = buyers.select(
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.lit("")).alias("internal_id"),
        F.col("c_custkey").cast("string").alias("internal_customer_id"),
        F.struct(F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@example.org")).alias("email"), F.col("n_name").alias("country"),
                 F.col("c_mktsegment").alias("rfm_today__b3103f82")).alias("properties"))
    return tables.customer_attributes(raw).select("customer_id", "email", "country", "rfm_segment")


@query("detected_attributes", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'top' ELSE c_mktsegment END AS loyalty_tier,
  CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'bare' ELSE 'hashed' END AS last_name,
  'n' || c_nationkey AS country, 'raw' AS city FROM customer""")
def detected_attributes(spark, folder):
    c = F.col("c_custkey")
    properties = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("loyalty_tier").alias("k"), F.col("c_mktsegment").alias("v")),
        F.struct(F.when(c % 3 == 0, "last_name").when(c % 3 == 1, "lastname").otherwise("last_name__a1").alias("k"),
                 F.when(c % 3 == 0, "exact").when(c % 3 == 1, "bare").otherwise("hashed").alias("v")),
        F.struct(F.lit("land").alias("k"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("v")),
        F.struct(F.lit("city").alias("k"), F.lit(None).cast("string").alias("v")),
    ), lambda e: e["k"].isNotNull()))
    raw = retail.table(spark, folder, "customer").select(
        c.alias("customer_id"), F.when(c % 2 == 0, F.lit("top")).alias("loyalty_tier"), properties.alias("properties"),
        F.create_map(F.lit("city"), F.lit("raw")).alias("raw_properties"))
    return tables.detected_attributes(raw, "customer_id", ("loyalty_tier", "last_name", "city"),
                                      {"country": mapping.FieldMapping("properties.land")})


_SAMPLE = """
ids AS (
  SELECT customer_id FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS customer_id FROM events
    WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00')
  ORDER BY md5(customer_id || ':42'), customer_id LIMIT 40)
"""


@query("customer_consistent_sample", with_(_SAMPLE, select="""
SELECT CAST(user_id AS VARCHAR) AS customer_id, count(*) AS n_events, round(sum(value), 6) AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'
  AND CAST(user_id AS VARCHAR) IN (SELECT customer_id FROM ids) GROUP BY 1"""))
def customer_consistent_sample(spark, folder):
    source = {"events": retail.table(spark, folder, "events")}
    span = ("2024-01-03 00:00:00", "2024-01-25 00:00:00")
    ids = sampling.sampled_ids(source, 40, 42, *span)
    rows = sampling.sample_tables(source, ids, *span)["events"]
    return rows.groupBy(F.col("user_id").cast("string").alias("customer_id")).agg(
        F.count("*").alias("n_events"), r6(F.sum("value")).alias("value"))


@query("sampled_customer_ids", with_(_SAMPLE, select="SELECT customer_id FROM ids"))
def sampled_customer_ids(spark, folder):
    return sampling.sampled_ids({"events": retail.table(spark, folder, "events")}, 40, 42,
                                "2024-01-03 00:00:00", "2024-01-25 00:00:00")


@query("dataset_statistics", with_(WEB, select="""
SELECT count(DISTINCT customer_id) AS n_customers, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases,
  round(CAST(sum(amount) FILTER (WHERE event_type = 'purchase') AS DOUBLE), 6) AS total_revenue,
  round(count(*) / count(DISTINCT customer_id), 6) AS avg_events_per_customer FROM web_ev"""))
def dataset_statistics(spark, folder):
    row = tables.dataset_statistics(web_resolved(spark, folder))
    return row.select("n_customers", "n_events", "n_purchases", r6(F.col("total_revenue")).alias("total_revenue"),
                      r6(F.col("avg_events_per_customer")).alias("avg_events_per_customer"))


@query("event_type_distribution", with_(WEB, select="SELECT event_type, count(*) AS n_events FROM web_ev GROUP BY 1"))
def event_type_distribution(spark, folder):
    return tables.event_type_distribution(web_resolved(spark, folder))


@query("profile_documents", with_(profiles_sql("web"), select="""
SELECT customer_id, '{"customer_id":"' || customer_id || '","total_purchases":' || total_purchases || ',"behavior_type":"' || behavior_type || '"}' AS document
FROM profiles"""))
def profile_documents(spark, folder):
    rows = web_profiles(spark, folder).select("customer_id", "total_purchases", "behavior_type")
    return sinks.as_documents(rows, "customer_id")


@query("union_of_event_sources", with_(WEB, SHOP, select="""
SELECT 'web' AS source, event_type, count(*) AS n_events FROM web_ev GROUP BY 2
UNION ALL SELECT 'shop', event_type, count(*) FROM shop_ev GROUP BY 2"""))
def union_of_event_sources(spark, folder):
    web = web_resolved(spark, folder).select(F.lit("web").alias("source"), "event_type")
    shop = retail.shop_events(spark, folder).select(F.lit("shop").alias("source"), "event_type")
    return web.unionByName(shop).groupBy("source", "event_type").agg(F.count("*").alias("n_events"))


@query("customers_in_both_sources", with_(WEB, SHOP, select="""
SELECT customer_id FROM web_ev INTERSECT SELECT customer_id FROM shop_ev"""))
def customers_in_both_sources(spark, folder):
    return web_resolved(spark, folder).select("customer_id").intersect(retail.shop_events(spark, folder).select("customer_id"))


@query("distinct_categories", with_(SHOP, select="""
SELECT CAST(1 AS BIGINT) AS level, l1 AS category FROM shop_ev WHERE l1 IS NOT NULL GROUP BY 2
UNION ALL SELECT CAST(2 AS BIGINT), l2 FROM shop_ev WHERE l2 IS NOT NULL GROUP BY 2"""))
def distinct_categories(spark, folder):
    ev = retail.shop_events(spark, folder)
    pairs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("level"), F.col(f"category_level_{i}").alias("category")) for i in (1, 2)])
    return ev.select(F.inline(pairs)).where(F.col("category").isNotNull()).distinct()


@query("cast_rules", """
SELECT event_id, TRY_CAST(t AS DECIMAL(18,2))::DOUBLE AS as_decimal, TRY_CAST(CASE WHEN event_id % 4 = 1 THEN NULL ELSE t END AS BIGINT) AS as_int,
  round(TRY_CAST(t AS DOUBLE), 6) AS as_float, lower(t) IN ('true', '1', 'yes') AS as_bool
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 3 AS VARCHAR) WHEN 1 THEN CAST(value AS VARCHAR)
      WHEN 2 THEN 'Yes' ELSE 'bad' || event_id END AS t FROM events)""")
def cast_rules(spark, folder):
    n = F.col("event_id")
    text = (F.when(n % 4 == 0, (n % 3).cast("string")).when(n % 4 == 1, F.col("value").cast("string"))
            .when(n % 4 == 2, "Yes").otherwise(F.concat(F.lit("bad"), n)))
    return retail.table(spark, folder, "events").select(
        n, apply_rule(text, "decimal").cast("double").alias("as_decimal"), apply_rule(text, "int").alias("as_int"),
        r6(apply_rule(text, "float")).alias("as_float"), apply_rule(text, "bool").alias("as_bool"))


@query("text_rules", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, regexp_matches(lower(t), 'mobile|tablet|ios|android') AS is_mobile,
  TRY_CAST(replace(replace(t, ',', ''), ' ', '') AS DOUBLE) IS NOT NULL AS is_number,
  regexp_matches(t, '[>/|]|::|\\\\') AS is_hierarchy, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'My iOS App' WHEN 1 THEN '1,2 34.5' WHEN 2 THEN 'a > b' ELSE o_orderpriority END AS t FROM orders)""")
def text_rules(spark, folder):
    n = F.col("o_orderkey")
    text = F.when(n % 4 == 0, "My iOS App").when(n % 4 == 1, "1,2 34.5").when(n % 4 == 2, "a > b").otherwise(F.col("o_orderpriority"))
    return retail.table(spark, folder, "orders").select(
        n, mobile_substring(text).alias("is_mobile"), numeric_text(text).alias("is_number"),
        text.rlike(r"[>/|]|::|\\").alias("is_hierarchy"), F.length(text).cast("bigint").alias("n_chars"))


@query("time_parts", """
SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS weekday, CAST(hour(o_orderdate) AS BIGINT) AS hour,
  strftime(o_orderdate, '%Y-%m') AS year_month, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(dayofyear(o_orderdate) AS BIGINT) AS day_of_year,
  CAST(floor((epoch_us(TIMESTAMP '2001-09-01 00:00:00') - epoch_us(CAST(o_orderdate AS TIMESTAMP))) / 86400000000) AS BIGINT) AS age_days
FROM orders""")
def time_parts(spark, folder):
    from patronlens.functions.columns import whole_days

    at = F.col("o_orderdate").cast("timestamp")
    return retail.table(spark, folder, "orders").select(
        "o_orderkey", F.weekday(at).cast("bigint").alias("weekday"), F.hour(at).cast("bigint").alias("hour"),
        F.date_format(at, "yyyy-MM").alias("year_month"), F.month(at).cast("bigint").alias("month"),
        F.dayofyear(at).cast("bigint").alias("day_of_year"), whole_days(retail.instant(retail.SHOP_REFERENCE), at).alias("age_days"))


@query("reload_checked_history", with_(WEB, select="""
SELECT (SELECT count(*) FROM web_history) AS history_rows, count(*) AS resolved, CAST(0 AS BIGINT) AS issues FROM web_map"""))
def reload_checked_history(spark, folder):
    history = retail.web_id_history(spark, folder)
    resolved = identity.resolve_merges(history, strict=True)
    return resolved.agg(F.count("*").alias("resolved")).withColumn(
        "history_rows", history.agg(F.count("*")).scalar()).withColumn("issues", F.lit(0).cast("bigint"))
