"""Registered queries: traits, data quality and report datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import profiles as profiles_sql, with_
from patronlens.functions.columns import r6
from patronlens.operators import quality, reports, traits
from patronlens.plans.inputs import shop_affinity, shop_profiles, web_affinity, web_profiles, web_resolved
from patronlens.plans.registry import query
from patronlens.sources import retail


def tidy(frame, *keep_as_is):
    """Doubles and decimals at six places, whole numbers as BIGINT, the rest unchanged."""
    out = []
    for name, kind in frame.dtypes:
        if kind in ("double", "float") or kind.startswith("decimal"):
            out.append(r6(F.col(name)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return frame.select(*out)


_TRAITS = """
tp AS (
  SELECT p.*, a.engagement_score AS top_score, a.purchase_count AS top_purchases FROM profiles p
  LEFT JOIN aff_pos a ON a.customer_id = p.customer_id AND a.position = 1),
traits AS (
  SELECT customer_id, 'high_value_customer' AS trait, 'WHO' AS dimension, 'true' AS value FROM tp WHERE clv_estimate >= 500 OR total_revenue >= 200
  UNION ALL SELECT customer_id, 'churn_risk', 'WHO', CASE WHEN churn_risk_score >= 0.8 THEN 'high' ELSE 'moderate' END FROM tp WHERE churn_risk_score >= 0.6
  UNION ALL SELECT customer_id, 'high_value_dormant', 'WHO', 'true' FROM tp WHERE days_since_last_purchase >= 60 AND total_revenue >= 200
  UNION ALL SELECT customer_id, 'cart_abandoner', 'WHAT', 'num:' || CAST(round(cart_abandonment_rate, 6) AS VARCHAR) FROM tp
    WHERE total_cart_additions >= 2 AND cart_abandonment_rate >= 0.5
  UNION ALL SELECT customer_id, 'category_specialist', 'WHAT', top_category FROM tp WHERE top_score >= 0.7 AND top_purchases >= 2
  UNION ALL SELECT customer_id, 'discount_sensitive', 'WHAT', 'true' FROM tp
    WHERE total_purchases >= 2 AND avg_order_value <= 50 AND purchase_frequency_per_month >= 0.5
  UNION ALL SELECT customer_id, 'browser_not_buyer', 'WHAT', 'true' FROM tp WHERE total_items_viewed >= 10 AND total_purchases <= 1
  UNION ALL SELECT customer_id, 'weekend_shopper', 'WHEN', CASE preferred_day_of_week WHEN 5 THEN 'Saturday' ELSE 'Sunday' END FROM tp
    WHERE preferred_day_of_week IN (5, 6)
  UNION ALL SELECT customer_id, 'early_bird_shopper', 'WHEN', CAST(preferred_hour_of_day AS VARCHAR) FROM tp WHERE preferred_hour_of_day < 9
  UNION ALL SELECT customer_id, 'night_owl_shopper', 'WHEN', CAST(preferred_hour_of_day AS VARCHAR) FROM tp WHERE preferred_hour_of_day >= 21
  UNION ALL SELECT customer_id, 'seasonal_shopper', 'WHEN', 'true' FROM tp
    WHERE tenure_days >= 90 AND total_purchases >= 2 AND purchase_frequency_per_month <= 0.3
  UNION ALL SELECT customer_id, 'mobile_first', 'HOW', 'num:' || CAST(round(mobile_session_ratio, 6) AS VARCHAR) FROM tp WHERE mobile_session_ratio >= 0.7
  UNION ALL SELECT customer_id, 'desktop_loyalist', 'HOW', 'num:' || CAST(round(1 - mobile_session_ratio, 6) AS VARCHAR) FROM tp WHERE 1 - mobile_session_ratio >= 0.8
  UNION ALL SELECT customer_id, 'high_engagement', 'HOW', 'true' FROM tp WHERE total_sessions >= 10 AND total_page_views >= 30)
"""

_NUMERIC = ("cart_abandoner", "mobile_first", "desktop_loyalist")


def _web_traits(spark, folder):
    return traits.extract_traits(traits.with_top_affinity(web_profiles(spark, folder), web_affinity(spark, folder)))


def _shop_traits(spark, folder):
    return traits.extract_traits(traits.with_top_affinity(shop_profiles(spark, folder), shop_affinity(spark, folder)))


def _shown(frame):
    """Numeric trait values as a number column, so that text formats of doubles do not matter."""
    number = F.col("trait").isin(*_NUMERIC)
    return frame.select(
        "customer_id", "trait", "dimension", F.when(~number, F.col("value")).alias("value"),
        F.when(number, r6(F.col("value").try_cast("double"))).alias("number"))


_SHOWN_SQL = """
SELECT customer_id, trait, dimension, CASE WHEN value NOT LIKE 'num:%' THEN value END AS value,
  CASE WHEN value LIKE 'num:%' THEN CAST(substr(value, 5) AS DOUBLE) END AS number FROM traits"""


@query("customer_traits_web", with_(profiles_sql("web"), _TRAITS, select=_SHOWN_SQL))
def customer_traits_web(spark, folder):
    return _shown(_web_traits(spark, folder))


@query("customer_traits_shop", with_(profiles_sql("shop"), _TRAITS, select=_SHOWN_SQL))
def customer_traits_shop(spark, folder):
    return _shown(_shop_traits(spark, folder))


@query("trait_totals", with_(profiles_sql("web"), _TRAITS, select="""
SELECT trait, dimension, count(*) AS customers, round(count(*) / CAST((SELECT count(*) FROM profiles) AS DOUBLE), 6) AS share
FROM traits GROUP BY 1, 2"""))
def trait_totals(spark, folder):
    return tidy(traits.trait_totals(_web_traits(spark, folder), web_profiles(spark, folder)))


@query("trait_dimension_totals", with_(profiles_sql("shop"), _TRAITS, select="SELECT dimension, count(*) AS traits FROM traits GROUP BY 1"))
def trait_dimension_totals(spark, folder):
    return traits.dimension_totals(_shop_traits(spark, folder))


@query("traits_per_customer", with_(profiles_sql("web"), _TRAITS, select="""
SELECT p.customer_id, count(t.trait) AS n_traits FROM profiles p LEFT JOIN traits t ON t.customer_id = p.customer_id GROUP BY 1"""))
def traits_per_customer(spark, folder):
    return traits.traits_per_customer(_web_traits(spark, folder), web_profiles(spark, folder))


@query("interval_behavior_trait", with_(profiles_sql("shop"), select="""
SELECT CASE WHEN total_purchases = 0 THEN 'new' WHEN total_purchases = 1 THEN 'one_time' WHEN interval_mean IS NULL OR interval_cv IS NULL THEN 'new'
  WHEN interval_mean > 90 THEN 'long_cycle' WHEN interval_cv < 0.5 THEN 'regular' WHEN interval_cv < 1 THEN 'irregular' ELSE 'long_cycle' END AS value,
  behavior_type, count(*) AS customers FROM profiles GROUP BY 1, 2"""))
def interval_behavior_trait(spark, folder):
    built = shop_profiles(spark, folder)
    found = traits.extract_traits(built, [traits.behavior_rule()])
    return found.join(built.select("customer_id", "behavior_type"), "customer_id").groupBy("value", "behavior_type").agg(
        F.count("*").alias("customers"))


@query("user_defined_trait", with_(profiles_sql("shop"), select="""
SELECT customer_id, 'frequent_refunder' AS trait, 'WHO' AS dimension, CAST(total_refunds AS VARCHAR) AS value FROM profiles WHERE total_refunds >= 3"""))
def user_defined_trait(spark, folder):
    rule = traits.TraitRule("frequent_refunder", "WHO", F.col("total_refunds") >= 3, F.col("total_refunds"))
    return traits.extract_traits(shop_profiles(spark, folder), [rule])


@query("profile_quality", with_(profiles_sql("web"), select="""
SELECT rule, count(*) FILTER (WHERE bad) AS violations, count(*) AS checked FROM (
  SELECT unnest([
    {'rule': 'customer_id_required', 'bad': customer_id IS NULL OR customer_id = ''},
    {'rule': 'cart_abandonment_rate_in_unit_range', 'bad': NOT cart_abandonment_rate BETWEEN 0 AND 1},
    {'rule': 'mobile_session_ratio_in_unit_range', 'bad': NOT mobile_session_ratio BETWEEN 0 AND 1},
    {'rule': 'churn_risk_score_in_unit_range', 'bad': NOT churn_risk_score BETWEEN 0 AND 1},
    {'rule': 'raw_refund_rate_in_unit_range', 'bad': NOT raw_refund_rate BETWEEN 0 AND 1},
    {'rule': 'total_purchases_not_negative', 'bad': total_purchases < 0}, {'rule': 'total_revenue_not_negative', 'bad': total_revenue < 0},
    {'rule': 'avg_order_value_not_negative', 'bad': avg_order_value < 0}, {'rule': 'total_sessions_not_negative', 'bad': total_sessions < 0},
    {'rule': 'clv_estimate_not_negative', 'bad': clv_estimate < 0}, {'rule': 'total_refunds_not_negative', 'bad': total_refunds < 0},
    {'rule': 'behavior_type_known', 'bad': behavior_type NOT IN ('regular', 'irregular', 'long_cycle', 'new', 'one_time')},
    {'rule': 'seen_in_order', 'bad': first_seen > last_seen}], recursive := true) FROM profiles) GROUP BY 1"""))
def profile_quality(spark, folder):
    return quality.violations(web_profiles(spark, folder), quality.profile_rules())


@query("event_quality", """
SELECT unnest(['customer_id_required', 'ts_required', 'event_type_known', 'purchase_amount_present', 'amount_not_negative']) AS rule,
  unnest([a, b, c, d, e]) AS violations, n AS checked FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE user_id IS NULL) AS a, count(*) FILTER (WHERE ts IS NULL) AS b,
    count(*) FILTER (WHERE event_type NOT IN ('purchase')) AS c, CAST(0 AS BIGINT) AS d, count(*) FILTER (WHERE value < 0) AS e FROM events)""")
def event_quality(spark, folder):
    # the source's own event names: all but `purchase` are outside the canonical vocabulary
    rows = retail.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("customer_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.col("value").cast("decimal(18,2)").alias("total_amount"), F.lit(None).cast("decimal(18,2)").alias("order_total"))
    return quality.violations(rows, quality.event_rules())


@query("attribute_names_with_technical_wording", """
SELECT p_name, regexp_matches(lower(p_name || CASE WHEN p_partkey % 5 = 0 THEN ' cluster_' || p_size ELSE '' END), 'pca|embedding|latent|component|cluster_') AS technical,
  count(*) AS parts FROM part GROUP BY 1, 2""")
def attribute_names_with_technical_wording(spark, folder):
    label = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" cluster_"), "p_size")).otherwise(F.col("p_name"))
    return retail.table(spark, folder, "part").groupBy("p_name", quality.technical_wording(label).alias("technical")).agg(
        F.count("*").alias("parts"))


@query("loyalty_behavior_shares", with_(profiles_sql("shop"), select="""
SELECT behavior_type, count(*) AS customers, round(avg(total_purchases), 6) AS avg_orders,
  round(count(*) / CAST((SELECT count(*) FROM profiles) AS DOUBLE), 6) AS share, behavior_type = 'regular' AS is_champion FROM profiles GROUP BY 1"""))
def loyalty_behavior_shares(spark, folder):
    return tidy(reports.behavior_shares(shop_profiles(spark, folder)))


_HISTOGRAM = """
hist AS (SELECT CAST(least(total_purchases, 10) AS BIGINT) AS orders, count(*) AS customers,
  avg(CASE WHEN behavior_type IN ('one_time', 'new') THEN 0.0 ELSE 1.0 END) AS retention FROM profiles GROUP BY 1)
"""


@query("loyalty_order_histogram", with_(profiles_sql("shop"), _HISTOGRAM, select="SELECT orders, customers, round(retention, 6) AS retention FROM hist"))
def loyalty_order_histogram(spark, folder):
    return tidy(reports.order_histogram(shop_profiles(spark, folder)))


@query("loyalty_threshold", with_(profiles_sql("shop"), _HISTOGRAM, select="""
SELECT coalesce((SELECT orders FROM s WHERE jump > 0 ORDER BY jump DESC, orders LIMIT 1), 1) AS threshold_order,
  round(coalesce((SELECT jump FROM s WHERE jump > 0 ORDER BY jump DESC, orders LIMIT 1), 0.0), 6) AS retention_jump
FROM (SELECT 1) one""").replace("SELECT coalesce((SELECT orders FROM s", ", s AS (SELECT orders, retention - lag(retention, 1, 0.0) OVER (ORDER BY orders) AS jump FROM hist)\nSELECT coalesce((SELECT orders FROM s", 1))
def loyalty_threshold(spark, folder):
    return tidy(reports.loyalty_threshold(reports.order_histogram(shop_profiles(spark, folder))))


@query("loyalty_flow_links", with_(profiles_sql("shop"), select="""
SELECT * FROM (
  SELECT 'new' AS source, behavior_type AS target, count(*) AS value FROM profiles WHERE behavior_type <> 'new' GROUP BY 2
  UNION ALL SELECT 'irregular', 'regular', CAST(floor(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) FROM profiles WHERE behavior_type = 'regular') WHERE value > 0"""))
def loyalty_flow_links(spark, folder):
    return reports.behavior_flow(shop_profiles(spark, folder))


@query("loyalty_flow_nodes", with_(profiles_sql("shop"), select="""
SELECT id, name, CAST(g AS BIGINT) AS group_index, (SELECT count(*) FROM profiles WHERE behavior_type = id) AS customers FROM (VALUES
  ('regular', 'Regular', 1), ('irregular', 'Irregular', 1), ('long_cycle', 'Long Cycle', 1), ('new', 'New', 0), ('one_time', 'One Time', 1)) t(id, name, g)"""))
def loyalty_flow_nodes(spark, folder):
    return reports.flow_nodes(shop_profiles(spark, folder))


@query("first_seen_cohorts", with_(profiles_sql("shop"), select="""
SELECT strftime(first_seen, '%Y-%m') AS cohort, behavior_type, count(*) AS customers FROM profiles GROUP BY 1, 2"""))
def first_seen_cohorts(spark, folder):
    return reports.first_seen_cohorts(shop_profiles(spark, folder))


_CHAMPIONS = """
med AS (SELECT CAST(total_revenue AS DOUBLE) AS m FROM (SELECT total_revenue, row_number() OVER (ORDER BY total_revenue) - 1 AS pos,
  count(*) OVER () AS n FROM profiles) WHERE pos = n // 2),
ch0 AS (SELECT customer_id, CAST(total_revenue AS DOUBLE) AS revenue, coalesce(days_since_last_purchase, 0) AS days_since_purchase,
  churn_risk_score AS churn_risk, days_since_last_purchase IS NULL AS never_purchased FROM profiles, med
  WHERE behavior_type = 'regular' OR (CAST(total_revenue AS DOUBLE) >= m AND total_purchases >= 3)),
ch AS (SELECT *, 0.6 * least(days_since_purchase / CAST(90 AS DOUBLE), 1.0) + 0.4 * churn_risk AS fragility_score FROM ch0),
champ AS (SELECT *, days_since_purchase >= 45 OR fragility_score > 0.5 AS is_fragile FROM ch)
"""


@query("champion_fragility", with_(profiles_sql("shop"), _CHAMPIONS, select="""
SELECT customer_id, round(revenue, 6) AS revenue, days_since_purchase, round(churn_risk, 6) AS churn_risk, never_purchased,
  round(fragility_score, 6) AS fragility_score, is_fragile FROM champ"""))
def champion_fragility(spark, folder):
    return tidy(reports.champions(shop_profiles(spark, folder)).orderBy(F.desc("fragility_score"), "customer_id"))


@query("champion_summary", with_(profiles_sql("shop"), _CHAMPIONS, select="""
SELECT count(*) AS champions, count(*) FILTER (WHERE is_fragile) AS fragile, round(avg(CASE WHEN is_fragile THEN 1.0 ELSE 0.0 END), 6) AS fragile_share,
  round(CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE), 6) AS revenue, round(coalesce(CAST(sum(CAST(revenue AS DECIMAL(18,2))) FILTER (WHERE is_fragile) AS DOUBLE), 0), 6) AS revenue_at_risk,
  count(*) FILTER (WHERE fragility_score < 0.3) AS low, count(*) FILTER (WHERE fragility_score >= 0.3 AND fragility_score < 0.6) AS medium,
  count(*) FILTER (WHERE fragility_score >= 0.6) AS high, count(*) FILTER (WHERE days_since_purchase > 30) AS inactive_over_30_days,
  count(*) FILTER (WHERE churn_risk > 0.5) AS churn_over_half, count(*) FILTER (WHERE never_purchased) AS never_purchased FROM champ"""))
def champion_summary(spark, folder):
    return tidy(reports.champion_summary(reports.champions(shop_profiles(spark, folder))))


@query("revenue_order_statistics", with_(profiles_sql("shop"), select="""
SELECT max(CASE WHEN pos = n // 4 THEN v END) AS q25, max(CASE WHEN pos = n // 2 THEN v END) AS median, max(CASE WHEN pos = 3 * n // 4 THEN v END) AS q75
FROM (SELECT round(CAST(total_revenue AS DOUBLE), 6) AS v, row_number() OVER (ORDER BY total_revenue) - 1 AS pos, count(*) OVER () AS n FROM profiles)"""))
def revenue_order_statistics(spark, folder):
    return tidy(reports.order_statistics(shop_profiles(spark, folder), "total_revenue", {"q25": (1, 4), "median": (1, 2), "q75": (3, 4)}))


@query("new_customer_quality", with_(profiles_sql("shop"), select="""
SELECT count(*) AS customers, count(*) FILTER (WHERE total_purchases >= 2) AS second_purchase, count(*) FILTER (WHERE total_purchases >= 3) AS third_purchase,
  round(avg(CASE WHEN total_purchases >= 2 THEN 1.0 ELSE 0.0 END), 6) AS conversion_to_second,
  round(avg(CASE WHEN total_purchases >= 3 THEN 1.0 ELSE 0.0 END), 6) AS conversion_to_third,
  round(avg(CASE WHEN total_purchases = 1 THEN 1.0 ELSE 0.0 END), 6) AS churn_rate,
  count(*) FILTER (WHERE clv_estimate < q25) AS low_quality, count(*) FILTER (WHERE clv_estimate >= q25 AND clv_estimate < q75) AS medium_quality,
  count(*) FILTER (WHERE clv_estimate >= q75) AS high_quality, round(CAST(sum(CAST(clv_estimate AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_lifetime_value
FROM profiles, (SELECT max(CASE WHEN pos = n // 4 THEN v END) AS q25, max(CASE WHEN pos = 3 * n // 4 THEN v END) AS q75
  FROM (SELECT clv_estimate AS v, row_number() OVER (ORDER BY clv_estimate) - 1 AS pos, count(*) OVER () AS n FROM profiles)) c"""))
def new_customer_quality(spark, folder):
    return tidy(reports.new_customer_quality(shop_profiles(spark, folder)))


@query("lifetime_value_distribution", with_(profiles_sql("web"), select="""
SELECT CASE WHEN clv_estimate < 50 THEN '$0-50' WHEN clv_estimate < 100 THEN '$50-100' WHEN clv_estimate < 250 THEN '$100-250'
  WHEN clv_estimate < 500 THEN '$250-500' ELSE '$500+' END AS bucket, count(*) AS customers FROM profiles GROUP BY 1"""))
def lifetime_value_distribution(spark, folder):
    return reports.lifetime_distribution(web_profiles(spark, folder))


@query("churn_overview", with_(profiles_sql("shop"), select="""
SELECT count(*) FILTER (WHERE churn_risk_score >= 0.5) AS at_risk, round(avg(CASE WHEN churn_risk_score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS at_risk_share,
  round(coalesce(CAST(sum(CAST(clv_estimate AS DECIMAL(18,2))) FILTER (WHERE churn_risk_score >= 0.5) AS DOUBLE), 0.0), 6) AS value_at_risk,
  count(*) FILTER (WHERE days_since_last_purchase IS NULL) AS never_purchased,
  round(least(avg(coalesce(days_since_last_purchase, 0)) / 60, 1.0), 6) AS recency_risk_all,
  round(least(avg(coalesce(days_since_last_purchase, 0)) FILTER (WHERE churn_risk_score >= 0.5) / 60, 1.0), 6) AS recency_risk_at_risk,
  round(avg(churn_risk_score), 6) AS churn_score_all, round(avg(churn_risk_score) FILTER (WHERE churn_risk_score >= 0.5), 6) AS churn_score_at_risk,
  round(1 - least(avg(purchase_frequency_per_month) / 2, 1.0), 6) AS frequency_drop_all,
  round(1 - least(avg(purchase_frequency_per_month) FILTER (WHERE churn_risk_score >= 0.5) / 2, 1.0), 6) AS frequency_drop_at_risk FROM profiles"""))
def churn_overview(spark, folder):
    return tidy(reports.churn_overview(shop_profiles(spark, folder)))


@query("at_risk_customers", with_(profiles_sql("shop"), select="""
SELECT customer_id, round(churn_risk_score, 6) AS churn_risk, round(clv_estimate, 6) AS clv, coalesce(days_since_last_purchase, 0) AS days_since_purchase, total_purchases
FROM profiles WHERE churn_risk_score >= 0.5 ORDER BY churn_risk_score DESC, customer_id LIMIT 50"""))
def at_risk_customers(spark, folder):
    return tidy(reports.at_risk_customers(shop_profiles(spark, folder)))


_OPPORTUNITY = """
opp0 AS (SELECT category, count(*) FILTER (WHERE purchase_count > 0) AS buyers,
  count(*) FILTER (WHERE purchase_count = 0 AND engagement_score > 0.3) AS lookalikes,
  coalesce(CAST(sum(CAST(clv_estimate AS DECIMAL(18,2))) FILTER (WHERE purchase_count > 0) AS DOUBLE), 0.0) AS v,
  coalesce(avg(engagement_score) FILTER (WHERE purchase_count = 0 AND engagement_score > 0.3), 0.0) AS avg_similarity
  FROM aff JOIN profiles USING (customer_id) GROUP BY 1),
opp AS (SELECT *, coalesce(v / nullif(buyers, 0), 0.0) AS buyer_avg_clv FROM opp0)
"""


@query("category_opportunities", with_(profiles_sql("web"), _OPPORTUNITY, select="""
SELECT category, buyers, lookalikes, round(avg_similarity, 6) AS avg_similarity, round(buyer_avg_clv, 6) AS buyer_avg_clv,
  round(buyer_avg_clv * lookalikes * CAST(0.15 AS DOUBLE), 6) AS opportunity_value FROM opp"""))
def category_opportunities(spark, folder):
    return tidy(reports.category_opportunities(web_affinity(spark, folder), web_profiles(spark, folder)))


@query("top_category_opportunities", with_(profiles_sql("shop"), _OPPORTUNITY, select="""
SELECT category, buyers, lookalikes, round(buyer_avg_clv * lookalikes * CAST(0.15 AS DOUBLE), 6) AS opportunity_value FROM opp
ORDER BY buyer_avg_clv * lookalikes * CAST(0.15 AS DOUBLE) DESC, category LIMIT 10"""))
def top_category_opportunities(spark, folder):
    found = reports.category_opportunities(shop_affinity(spark, folder), shop_profiles(spark, folder))
    return tidy(reports.top_categories(found).select("category", "buyers", "lookalikes", "opportunity_value"))


@query("report_period", with_(profiles_sql("web"), select="""
SELECT count(*) AS customers, strftime(min(first_seen), '%Y-%m-%d') AS period_start, strftime(max(last_seen), '%Y-%m-%d') AS period_end,
  (SELECT count(*) FROM web_ev) AS events FROM profiles"""))
def report_period(spark, folder):
    return reports.data_period(web_profiles(spark, folder), web_resolved(spark, folder))
