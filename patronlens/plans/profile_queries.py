"""Registered queries: identity, profiles, affinities, population figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import SHOP, WEB, profiles as profiles_sql, with_
from patronlens.functions.columns import r6
from patronlens.operators import identity, profiles
from patronlens.plans.inputs import (
    fresh_shop_affinity, fresh_shop_profiles, fresh_web_affinity, fresh_web_profiles, shop_profiles, web_affinity, web_merge_map,
    web_profiles, web_resolved,
)
from patronlens.plans.registry import query
from patronlens.sources import retail

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(name: str):
    return F.date_format(name, STAMP).alias(name)


def stamp_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


@query("profiles_value_by_behavior", with_(profiles_sql("web"), select="""
SELECT behavior_type, count(*) AS customers, round(CAST(sum(total_revenue) AS DOUBLE), 6) AS revenue,
       round(avg(avg_order_value), 6) AS avg_order_value FROM profiles GROUP BY 1"""))
def profiles_value_by_behavior(spark, folder):
    return fresh_web_profiles(spark, folder).groupBy("behavior_type").agg(
        F.count("*").alias("customers"), r6(F.sum("total_revenue")).alias("revenue"),
        r6(F.avg("avg_order_value")).alias("avg_order_value"))


@query("identity_resolution", with_(WEB, select="SELECT past_id, canonical_id, CAST(depth AS BIGINT) AS depth FROM web_map"))
def identity_resolution(spark, folder):
    return web_merge_map(spark, folder)


@query("remapped_event_counts", with_(WEB, select="SELECT customer_id, count(*) AS n_events FROM web_ev GROUP BY 1"))
def remapped_event_counts(spark, folder):
    return identity.event_counts(web_resolved(spark, folder))


@query("known_ids_by_customer", with_(WEB, select="""
SELECT DISTINCT canonical_id, canonical_id AS known_id, true AS is_canonical FROM web_map
UNION ALL SELECT canonical_id, past_id, false FROM web_map"""))
def known_ids_by_customer(spark, folder):
    return identity.ids_by_customer(web_merge_map(spark, folder))


@query("merge_statistics", with_(WEB, select="""
SELECT (SELECT count(*) FROM web_history) AS total_past_ids, count(DISTINCT canonical_id) AS unique_canonical_ids,
       round(avg(depth), 6) AS avg_chain_depth, CAST(max(depth) AS BIGINT) AS max_chain_depth,
       count(DISTINCT canonical_id) AS customers_with_merges FROM web_map"""))
def merge_stats(spark, folder):
    stats = identity.merge_statistics(retail.web_id_history(spark, folder), web_merge_map(spark, folder))
    return stats.withColumn("avg_chain_depth", r6(F.col("avg_chain_depth")))


# Deliberately broken history: a merge edge per order between its customer and a
# function of it, which yields duplicates, self references and cycles.
_MESSY = """
messy AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS past_id, CAST((o_custkey * 7) % 101 AS VARCHAR) AS target FROM orders
  UNION ALL
  SELECT DISTINCT CAST(o_custkey AS VARCHAR), CAST((o_custkey * 7) % 101 AS VARCHAR) FROM orders WHERE o_custkey % 50 = 3),
edge AS (SELECT past_id, min(target) AS target FROM messy GROUP BY 1),
walk AS (
  SELECT past_id, target AS node, 0 AS depth, [past_id] AS seen, false AS looped FROM edge
  UNION ALL
  SELECT w.past_id, e.target, w.depth + 1, list_append(w.seen, w.node), false
  FROM walk w JOIN edge e ON e.past_id = w.node WHERE w.depth < 10 AND NOT list_contains(w.seen, w.node)),
verdict AS (
  SELECT past_id, max(CASE WHEN depth < 10 AND list_contains(seen, node) THEN 1 ELSE 0 END) AS looped, max(depth) AS depth
  FROM walk GROUP BY 1)
"""


@query("merge_history_issues", with_(_MESSY, select="""
SELECT issue, count(*) AS n FROM (
  SELECT past_id, 'duplicate' AS issue FROM messy GROUP BY past_id HAVING count(*) > 1
  UNION ALL SELECT DISTINCT past_id, 'self_reference' FROM messy WHERE past_id = target
  UNION ALL SELECT past_id, 'cycle' FROM verdict WHERE looped = 1
  UNION ALL SELECT past_id, 'too_deep' FROM verdict WHERE looped = 0 AND depth >= 10) GROUP BY 1"""))
def merge_history_issues(spark, folder):
    buyers = retail.table(spark, folder, "orders").select("o_custkey").distinct()
    edges = buyers.unionAll(buyers.where("o_custkey % 50 = 3")).select(
        F.col("o_custkey").cast("string").alias("past_id"),
        ((F.col("o_custkey") * 7) % 101).cast("string").alias("internal_customer_id"),
        retail.instant("2024-01-15 00:00:00").alias("merge_timestamp"))
    return identity.merge_issues(edges).groupBy("issue").agg(F.count("*").alias("n"))


_PROFILE_COLUMNS = (
    "customer_id", "total_events", "total_purchases", "total_revenue", "avg_order_value", "total_refunds", "refund_rate",
    "raw_refund_rate", "days_since_last_purchase", "purchase_frequency_per_month", "total_sessions", "total_page_views",
    "total_items_viewed", "total_cart_additions", "cart_abandonment_rate", "preferred_day_of_week", "preferred_hour_of_day",
    "primary_device_type", "mobile_session_ratio", "top_category", "category_count", "interval_mean", "interval_std",
    "interval_min", "interval_max", "interval_cv", "regularity_index", "clv_estimate", "churn_risk_score", "behavior_type",
    "tenure_days",
)
_FLOATS = {
    "total_revenue", "avg_order_value", "refund_rate", "raw_refund_rate", "purchase_frequency_per_month",
    "cart_abandonment_rate", "mobile_session_ratio", "interval_mean", "interval_std", "interval_min", "interval_max",
    "interval_cv", "regularity_index", "clv_estimate", "churn_risk_score",
}
_TEXT = {"customer_id", "primary_device_type", "top_category", "behavior_type"}


def plain(frame, columns):
    """Comparable output: doubles at six places, whole numbers as BIGINT."""
    out = []
    for name in columns:
        if name in _FLOATS:
            out.append(r6(F.col(name)).alias(name))
        elif name in _TEXT:
            out.append(F.col(name))
        else:
            out.append(F.col(name).cast("bigint").alias(name))
    return frame.select(*out)


def plain_sql(columns) -> str:
    return ", ".join(
        f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c in _FLOATS else c if c in _TEXT else f"CAST({c} AS BIGINT) AS {c}"
        for c in columns)


for _name, _builder, _src in (("customer_profiles_web", fresh_web_profiles, "web"), ("customer_profiles_shop", fresh_shop_profiles, "shop")):
    query(_name, with_(profiles_sql(_src), select=f"SELECT {plain_sql(_PROFILE_COLUMNS)} FROM profiles"))(
        lambda spark, folder, b=_builder: plain(b(spark, folder), _PROFILE_COLUMNS))


def _metric_query(name: str, columns: tuple[str, ...]) -> None:
    columns = ("customer_id",) + columns
    query(name, with_(profiles_sql("web"), select=f"SELECT {plain_sql(columns)} FROM profiles"))(
        lambda spark, folder: plain(web_profiles(spark, folder), columns))


_metric_query("purchase_metrics", ("total_purchases", "total_revenue", "avg_order_value", "total_refunds", "raw_refund_rate",
                                   "days_since_last_purchase", "purchase_frequency_per_month"))
_metric_query("session_metrics", ("total_sessions", "total_page_views", "total_items_viewed", "total_cart_additions",
                                  "cart_abandonment_rate"))
_metric_query("device_metrics", ("primary_device_type", "mobile_session_ratio"))
_metric_query("lifetime_value_estimate", ("clv_estimate",))
_metric_query("churn_risk", ("churn_risk_score",))
_metric_query("behavior_types", ("behavior_type",))


@query("temporal_metrics", with_(profiles_sql("web"), select=f"""
SELECT customer_id, CAST(preferred_day_of_week AS BIGINT) AS preferred_day_of_week,
       CAST(preferred_hour_of_day AS BIGINT) AS preferred_hour_of_day, {stamp_sql('first_seen')}, {stamp_sql('last_seen')}
FROM profiles"""))
def temporal_metrics(spark, folder):
    return web_profiles(spark, folder).select(
        "customer_id", F.col("preferred_day_of_week").cast("bigint").alias("preferred_day_of_week"),
        F.col("preferred_hour_of_day").cast("bigint").alias("preferred_hour_of_day"), stamp("first_seen"), stamp("last_seen"))


_INTERVALS = ("customer_id", "interval_mean", "interval_std", "interval_min", "interval_max", "interval_cv", "regularity_index")


@query("purchase_intervals", with_(profiles_sql("shop"), select=f"""
SELECT {plain_sql(_INTERVALS)} FROM profiles WHERE interval_mean IS NOT NULL"""))
def purchase_intervals(spark, folder):
    return plain(profiles.interval_stats(retail.shop_events(spark, folder)), _INTERVALS)


_AFF_SQL = """SELECT customer_id, CAST(level AS BIGINT) AS level, category, CAST(engagement AS BIGINT) AS engagement,
 view_count, purchase_count, round(engagement_score, 6) AS engagement_score FROM aff"""


def _affinity_columns(frame):
    return frame.select("customer_id", F.col("level").cast("bigint").alias("level"), "category", "engagement", "view_count",
                        "purchase_count", r6(F.col("engagement_score")).alias("engagement_score"))


@query("category_affinity_web", with_(profiles_sql("web"), select=_AFF_SQL))
def category_affinity_web(spark, folder):
    return _affinity_columns(fresh_web_affinity(spark, folder))


@query("category_affinity_shop", with_(profiles_sql("shop"), select=_AFF_SQL))
def category_affinity_shop(spark, folder):
    return _affinity_columns(fresh_shop_affinity(spark, folder))


@query("affinity_ranking", with_(profiles_sql("web"), select="""
SELECT customer_id, category, CAST(position AS BIGINT) AS position FROM aff_pos"""))
def affinity_ranking(spark, folder):
    return profiles.ranked_affinity(web_affinity(spark, folder)).select(
        "customer_id", "category", F.col("position").cast("bigint").alias("position"))


@query("affinity_lists", with_(profiles_sql("web"), select="""
SELECT customer_id, string_agg(category || ':' || level || ':' || view_count || ':' || purchase_count, ',' ORDER BY position) AS affinities
FROM aff_pos GROUP BY 1"""))
def affinity_lists(spark, folder):
    nested = profiles.nested_affinity(web_affinity(spark, folder))
    return nested.select("customer_id", F.array_join(F.transform("category_affinities", lambda a: F.concat_ws(
        ":", a["category"], a["level"], a["views"], a["purchases"])), ",").alias("affinities"))


@query("frequent_customers", with_(profiles_sql("web"), select="""
SELECT customer_id, total_events FROM profiles WHERE total_events >= 60"""))
def frequent_customers(spark, folder):
    built = profiles.build_profiles(web_resolved(spark, folder), retail.instant(retail.WEB_REFERENCE), min_events=60)
    return built.select("customer_id", "total_events")


@query("profiles_until_cutoff", with_(profiles_sql("web"), select=f"""
SELECT customer_id, {stamp_sql('last_seen')} FROM profiles WHERE last_seen <= TIMESTAMP '2024-01-29 12:00:00'"""))
def profiles_until_cutoff(spark, folder):
    return profiles.seen_until(web_profiles(spark, folder), retail.instant("2024-01-29 12:00:00")).select(
        "customer_id", stamp("last_seen"))


@query("trailing_window_customers", with_(profiles_sql("shop"), select="""
SELECT CAST(w.d AS BIGINT) AS window_days, count(*) AS customers, count(DISTINCT customer_id) AS distinct_customers
FROM profiles, (SELECT unnest([30, 60, 90]) AS d) w, (SELECT max(last_seen) AS m FROM profiles) x
WHERE first_seen <= m AND last_seen >= m - to_days(CAST(w.d AS INTEGER)) GROUP BY 1"""))
def trailing_window_customers(spark, folder):
    tagged = profiles.trailing_windows(shop_profiles(spark, folder))
    return tagged.groupBy(F.col("window_days").cast("bigint").alias("window_days")).agg(
        F.count("*").alias("customers"), F.count_distinct("customer_id").alias("distinct_customers"))


_SUMMARY_SQL = """
SELECT count(*) AS n_customers, round(CAST(sum(total_revenue) AS DOUBLE), 6) AS total_revenue,
  round(CAST(sum(total_revenue) AS DOUBLE) / count(*), 6) AS avg_revenue_per_customer,
  CAST(sum(total_purchases) AS BIGINT) AS total_purchases, round(avg(total_purchases), 6) AS avg_purchases_per_customer,
  CAST(sum(total_sessions) AS BIGINT) AS total_sessions, round(avg(total_sessions), 6) AS avg_sessions_per_customer,
  round(CAST(sum(CAST(clv_estimate AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_clv, round(avg(churn_risk_score), 6) AS avg_churn_risk,
  round(avg(CASE WHEN total_purchases > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_with_purchases,
  round(avg(cart_abandonment_rate), 6) AS avg_cart_abandonment_rate FROM profiles"""


@query("population_summary", with_(profiles_sql("web"), select=_SUMMARY_SQL))
def population_summary(spark, folder):
    row = profiles.population_summary(web_profiles(spark, folder))
    whole = {"n_customers", "total_purchases", "total_sessions"}
    return row.select(*[F.col(c) if c in whole else r6(F.col(c)).alias(c) for c in row.columns])
