"""Registered queries: lookalikes and whitespace per category."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import profiles as profiles_sql, with_
from patronlens.functions.lineage import cut
from patronlens.operators import clustering, whitespace
from patronlens.plans import inputs
from patronlens.plans.inputs import shop_affinity, shop_profiles
from patronlens.plans.registry import query
from patronlens.plans.report_queries import tidy
from patronlens.plans.segment_queries import members, members_sql


def _scaled(names, group) -> str:
    return ", ".join(f"({n} - avg({n}) FILTER (WHERE role = 'buyer') OVER w) / CASE WHEN stddev_pop({n}) FILTER (WHERE role = 'buyer') OVER w = 0 THEN 1 ELSE stddev_pop({n}) FILTER (WHERE role = 'buyer') OVER w END AS {n}"
                     for n in names)


def _knn(rows: str, names, group: str) -> str:
    """Brute force over all pairs of a group: the independent answer to the pruned search."""
    unit = ", ".join(f"{n} / len AS {n}" for n in names)
    dot = " + ".join(f"c.{n} * b.{n}" for n in names)
    on = " AND ".join(f"c.{g} = b.{g}" for g in group.split(", "))
    cg = ", ".join(f"c.{g}" for g in group.split(", "))
    return f"""
sized AS (SELECT *, count(*) FILTER (WHERE role = 'buyer') OVER (PARTITION BY {group}) AS n_buyers FROM {rows}),
scl AS (SELECT customer_id, {group}, role, {_scaled(names, group)} FROM sized WHERE n_buyers >= 5 WINDOW w AS (PARTITION BY {group})),
lens AS (SELECT *, sqrt({" + ".join(f"{n} * {n}" for n in names)}) AS len FROM scl),
vec AS (SELECT customer_id, {group}, role, {unit} FROM lens WHERE len > 0),
pairs AS (SELECT {cg}, c.customer_id, b.customer_id AS neighbour_id, {dot} AS similarity FROM vec c JOIN vec b ON {on} AND c.role = 'candidate' AND b.role = 'buyer'),
near AS (SELECT *, row_number() OVER (PARTITION BY {group}, customer_id ORDER BY similarity DESC, neighbour_id) AS position FROM pairs WHERE similarity > 0),
looks AS (SELECT {group}, customer_id, avg(similarity) AS similarity FROM near WHERE position <= 5 GROUP BY {group}, customer_id HAVING avg(similarity) >= 0.5),
wstat AS (SELECT {group}, count(*) FILTER (WHERE role = 'buyer') AS n_buyers, CAST(sum(total_revenue) FILTER (WHERE role = 'buyer') AS DOUBLE) / count(*) FILTER (WHERE role = 'buyer') AS buyer_avg_clv,
  avg(total_purchases) FILTER (WHERE role = 'buyer') AS buyer_avg_purchases, count(*) FILTER (WHERE role = 'candidate') AS n_candidates FROM {rows} GROUP BY {group} HAVING count(*) FILTER (WHERE role = 'buyer') >= 5),
lstat AS (SELECT {group}, count(*) AS n_lookalikes, avg(similarity) AS avg_similarity FROM looks GROUP BY {group}),
ws AS (SELECT s.*, coalesce(n_lookalikes, 0) AS n_lookalikes, coalesce(avg_similarity, 0.0) AS avg_similarity, buyer_avg_clv * coalesce(n_lookalikes, 0) AS opportunity_value
  FROM wstat s LEFT JOIN lstat USING ({group}))
"""


_ROWS = """
wrows AS (SELECT customer_id, level, category, CASE WHEN purchase_count > 0 THEN 'buyer' ELSE 'candidate' END AS role, CAST(view_count AS DOUBLE) AS category_view_count,
  engagement_score AS category_engagement_score, CAST(total_sessions AS DOUBLE) AS total_sessions, CAST(total_page_views AS DOUBLE) AS total_page_views, cart_abandonment_rate, mobile_session_ratio,
  total_revenue, total_purchases, total_items_viewed, total_cart_additions FROM aff JOIN profiles USING (customer_id) WHERE purchase_count > 0 OR view_count >= 1)
"""
_KNN = _knn("wrows", whitespace.CATEGORY_FEATURES, "level, category")
_RANKED = "cand AS (SELECT *, row_number() OVER (PARTITION BY level, category ORDER BY similarity DESC, customer_id) AS position FROM looks)"


def oracle(select: str, *more: str) -> str:
    return with_(profiles_sql("shop"), _ROWS, _KNN, _RANKED, *more, select=select)


def _rows(spark, folder):
    return whitespace.category_engagement(shop_affinity(spark, folder), shop_profiles(spark, folder))


def fresh_whitespace(spark, folder):
    """(rows, statistics, lookalikes) from the materialised profiles and affinities."""
    rows = cut(_rows(spark, folder))
    statistics, found = whitespace.alike(rows, whitespace.KEYS, whitespace.CATEGORY_FEATURES)
    return rows, cut(statistics), cut(found)


_MADE: dict = {}


def _whitespace(spark, folder):
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MADE:
        _MADE[key] = fresh_whitespace(spark, folder)
    return _MADE[key]


@query("engagement_features", with_(profiles_sql("web"), select="""
SELECT customer_id, CAST(total_sessions AS DOUBLE) AS total_sessions, CAST(total_page_views AS DOUBLE) AS total_page_views, CAST(total_items_viewed AS DOUBLE) AS total_items_viewed,
  CAST(total_cart_additions AS DOUBLE) AS total_cart_additions, round(cart_abandonment_rate, 6) AS cart_abandonment_rate, round(mobile_session_ratio, 6) AS mobile_session_ratio,
  CAST(tenure_days + 1 AS DOUBLE) AS days_active, round(total_sessions / CAST(tenure_days + 1 AS DOUBLE), 6) AS session_frequency FROM profiles"""))
def engagement_features(spark, folder):
    return tidy(whitespace.engagement_features(inputs.web_profiles(spark, folder)))


@query("category_engagement_features", oracle("""
SELECT customer_id, CAST(level AS BIGINT) AS level, category, role, category_view_count, round(category_engagement_score, 6) AS category_engagement_score, total_sessions, total_page_views FROM wrows"""))
def category_engagement_features(spark, folder):
    return tidy(_rows(spark, folder).select("customer_id", "level", "category", "role", "category_view_count", "category_engagement_score",
                                            "total_sessions", "total_page_views"))


@query("category_neighbours", oracle("""
SELECT CAST(level AS BIGINT) AS level, category, customer_id, count(*) AS n, round(sum(similarity), 6) AS similarity FROM near WHERE position <= 5 GROUP BY 1, 2, 3"""))
def category_neighbours(spark, folder):
    _, neighbours = whitespace.similarity(cut(_rows(spark, folder)), whitespace.KEYS, whitespace.CATEGORY_FEATURES)
    return tidy(neighbours.groupBy("level", "category", F.col("id").alias("customer_id")).agg(
        F.count("*").alias("n"), F.sum("similarity").alias("similarity")))


@query("category_lookalikes", oracle("SELECT CAST(level AS BIGINT) AS level, category, customer_id, round(similarity, 6) AS similarity FROM looks"))
def category_lookalikes(spark, folder):
    return tidy(_whitespace(spark, folder)[2].select("level", "category", "customer_id", "similarity"))


_WS = """SELECT CAST(level AS BIGINT) AS level, category, n_buyers, n_candidates, n_lookalikes, round(buyer_avg_clv, 6) AS buyer_avg_clv, round(buyer_avg_purchases, 6) AS buyer_avg_purchases,
  round(avg_similarity, 6) AS avg_similarity, round(opportunity_value, 4) AS opportunity_value FROM ws"""


def _shown(frame):
    return tidy(frame.withColumn("opportunity_value", F.round("opportunity_value", 4)))


@query("category_whitespace", oracle(_WS))
def category_whitespace(spark, folder):
    return _shown(whitespace.category_whitespace(*_whitespace(spark, folder)))


# Predictions by a fixed rule, for every second customer; the others keep their revenue.
_PREDICTED = """
valued AS (SELECT * REPLACE (CASE WHEN CAST(customer_id AS BIGINT) % 2 = 0 THEN CAST(total_purchases * 100.25 AS DECIMAL(18,2)) ELSE total_revenue END AS total_revenue) FROM profiles)"""


@query("category_whitespace_predicted", with_(profiles_sql("shop"), _PREDICTED, _ROWS.replace("JOIN profiles", "JOIN valued"), _KNN, select=_WS))
def category_whitespace_predicted(spark, folder):
    """Predicted lifetime values in place of revenue: the neighbours stay, the value of a category changes."""
    people = shop_profiles(spark, folder)
    predictions = people.where(F.col("customer_id").cast("bigint") % 2 == 0).select("customer_id", (F.col("total_purchases") * 100.25).alias("predicted_clv"))
    rows = cut(whitespace.category_engagement(shop_affinity(spark, folder), clustering.valued_by(people, predictions)))
    statistics, found = whitespace.alike(rows, whitespace.KEYS, whitespace.CATEGORY_FEATURES)
    return _shown(whitespace.category_whitespace(rows, statistics, found))


@query("top_whitespace_categories", oracle(_WS + " WHERE n_lookalikes > 0 ORDER BY ws.opportunity_value DESC, level, category LIMIT 5"))
def top_whitespace_categories(spark, folder):
    return _shown(whitespace.top_whitespace(whitespace.category_whitespace(*_whitespace(spark, folder))))


@query("top_lookalike_candidates", oracle("""SELECT CAST(level AS BIGINT) AS level, category, customer_id, round(similarity, 6) AS similarity, position FROM cand WHERE position <= 100"""))
def top_lookalike_candidates(spark, folder):
    return tidy(whitespace.ranked_candidates(_whitespace(spark, folder)[2]).drop("nearest_buyers"))


@query("top_opportunities", oracle("""SELECT round(similarity, 6) AS similarity, count(*) AS n FROM (SELECT similarity FROM cand WHERE position <= 10 ORDER BY similarity DESC, level, category, customer_id LIMIT 100) GROUP BY 1"""))
def top_opportunities(spark, folder):
    found = whitespace.top_opportunities(_whitespace(spark, folder)[2])
    return tidy(found).groupBy("similarity").agg(F.count("*").alias("n"))


@query("buyer_lookalike_averages", oracle("""
SELECT CAST(level AS BIGINT) AS level, category, role, count(*) AS customers, round(avg(total_sessions), 6) AS avg_sessions, round(avg(total_page_views), 6) AS avg_page_views, round(avg(total_items_viewed), 6) AS avg_items_viewed,
  round(avg(total_cart_additions), 6) AS avg_cart_additions, round(CAST(sum(total_revenue) AS DOUBLE) / count(*), 6) AS avg_clv, round(avg(total_purchases), 6) AS avg_purchases, round(avg(category_view_count), 6) AS avg_category_views
FROM (SELECT * FROM wrows WHERE role = 'buyer' UNION ALL SELECT r.* REPLACE ('lookalike' AS role) FROM wrows r JOIN looks USING (level, category, customer_id)) GROUP BY 1, 2, 3"""))
def buyer_lookalike_averages(spark, folder):
    rows, _, found = _whitespace(spark, folder)
    return tidy(whitespace.role_averages(rows, found))


@query("whitespace_summary", oracle("""SELECT count(*) AS categories, CAST(sum(n_lookalikes) AS BIGINT) AS opportunities, round(sum(opportunity_value), 2) AS opportunity_value, round(avg(avg_similarity), 6) AS avg_similarity,
  (SELECT count(*) FROM profiles) AS customers FROM ws WHERE n_lookalikes > 0"""))
def whitespace_summary(spark, folder):
    found = whitespace.whitespace_summary(whitespace.category_whitespace(*_whitespace(spark, folder)), shop_profiles(spark, folder))
    return tidy(found.withColumn("opportunity_value", F.round("opportunity_value", 2)))


_SEGMENT_WS = """
segws AS (SELECT segment_id, level, category, count(*) AS n_lookalikes, avg(similarity) AS avg_similarity, count(*) * any_value(buyer_avg_clv) AS opportunity_value
  FROM members JOIN cand USING (customer_id) JOIN (SELECT level, category, buyer_avg_clv FROM ws) USING (level, category) GROUP BY 1, 2, 3)"""


def _segment_ws(spark, folder, groups=5):
    found = _whitespace(spark, folder)
    categories = whitespace.category_whitespace(*found)
    return whitespace.segment_whitespace(members(shop_profiles(spark, folder), groups), found[2], categories)


#: Shop categories and lookalikes, then the whitespace of each segment of the `members` defined before them.
SEGMENT_WHITESPACE_SQL = (_ROWS, _KNN, _RANKED, _SEGMENT_WS, """
segopp AS (SELECT segment_id, sum(opportunity_value) AS whitespace_value FROM segws GROUP BY 1)""")


def segment_values(spark, folder, groups):
    """(segment_id, whitespace_value) of the shop's segments."""
    return whitespace.segment_opportunity(_segment_ws(spark, folder, groups)).select("segment_id", "whitespace_value")


@query("segment_whitespace", oracle("""SELECT segment_id, CAST(level AS BIGINT) AS level, category, n_lookalikes, round(avg_similarity, 6) AS avg_similarity, round(opportunity_value, 4) AS opportunity_value FROM segws""",
                                    members_sql(5), _SEGMENT_WS))
def segment_whitespace(spark, folder):
    return _shown(_segment_ws(spark, folder).drop("buyer_avg_clv"))


@query("segment_opportunity", oracle("""SELECT segment_id, round(sum(opportunity_value), 2) AS whitespace_value, CAST(sum(n_lookalikes) AS BIGINT) AS n_lookalikes, arg_max(category, opportunity_value) AS top_category FROM segws GROUP BY 1""",
                                     members_sql(5), _SEGMENT_WS))
def segment_opportunity(spark, folder):
    return tidy(whitespace.segment_opportunity(_segment_ws(spark, folder)).withColumn("whitespace_value", F.round("whitespace_value", 2)))


_CROSS = """
crow AS (SELECT customer_id, 'Brand#3 -> Brand#7' AS pair, CASE WHEN b.customer_id IS NOT NULL THEN 'buyer' ELSE 'candidate' END AS role, CAST(total_sessions AS DOUBLE) AS total_sessions,
  CAST(total_page_views AS DOUBLE) AS total_page_views, CAST(total_items_viewed AS DOUBLE) AS total_items_viewed, CAST(total_cart_additions AS DOUBLE) AS total_cart_additions, cart_abandonment_rate,
  mobile_session_ratio, CAST(tenure_days + 1 AS DOUBLE) AS days_active, total_sessions / CAST(tenure_days + 1 AS DOUBLE) AS session_frequency, total_revenue, total_purchases
  FROM profiles LEFT JOIN (SELECT customer_id FROM aff WHERE level = 2 AND category = 'Brand#7' AND purchase_count > 0) b USING (customer_id)
  WHERE b.customer_id IS NOT NULL OR (customer_id IN (SELECT customer_id FROM aff WHERE level = 2 AND category = 'Brand#3' AND purchase_count > 0)
    AND customer_id IN (SELECT customer_id FROM aff WHERE level = 2 AND category = 'Brand#7' AND view_count > 0)))"""


@query("cross_category_opportunity", with_(profiles_sql("shop"), _CROSS, _knn("crow", whitespace.GENERAL_FEATURES, "pair"), select="""
SELECT pair, n_buyers, n_candidates, n_lookalikes, round(buyer_avg_clv, 6) AS buyer_avg_clv, round(avg_similarity, 6) AS avg_similarity, round(opportunity_value, 4) AS opportunity_value FROM ws"""))
def cross_category_opportunity(spark, folder):
    summary, _ = whitespace.cross_category(shop_affinity(spark, folder), shop_profiles(spark, folder), (2, "Brand#3"), (2, "Brand#7"))
    return _shown(summary.drop("buyer_avg_purchases"))
