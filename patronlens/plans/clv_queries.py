"""Registered queries: lifetime value features, evaluation, training and contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import profiles as profiles_sql, with_
from patronlens.functions.columns import r6
from patronlens.functions.lineage import cut
from patronlens.operators import clv, clustering
from patronlens.plans.inputs import shop_profiles, web_profiles
from patronlens.plans.registry import query
from patronlens.plans.report_queries import tidy
from patronlens.plans.segment_queries import members

_SQL = {
    "days_since_last_purchase": "coalesce(days_since_last_purchase, -1)",
    **{n: f"coalesce({n}, -1)" for n in clv.FEATURES["intervals"]},
    "preferred_dow": "preferred_day_of_week", "preferred_hour": "preferred_hour_of_day",
    "prefers_weekend": "CASE WHEN preferred_day_of_week IN (5, 6) THEN 1 ELSE 0 END",
    "revenue_per_session": "coalesce(CAST(total_revenue AS DOUBLE) / nullif(total_sessions, 0), 0)",
    "pages_per_session": "coalesce(total_page_views / nullif(total_sessions, 0), 0)",
    "items_per_session": "coalesce(total_items_viewed / nullif(total_sessions, 0), 0)",
    "cart_to_purchase_rate": "coalesce(total_purchases / nullif(total_cart_additions, 0), 0)",
    "purchase_per_session": "coalesce(total_purchases / nullif(total_sessions, 0), 0)",
    "activity_density": "CASE WHEN tenure_days > 0 THEN total_sessions / tenure_days ELSE total_sessions END",
    "top_category_score": "coalesce(t.engagement_score, 0)", "top_category_purchases": "coalesce(t.purchase_count, 0)",
    "category_concentration": "coalesce(t.engagement_score / t.total_score, 0)",
    **{f"is_{b}": f"CASE WHEN behavior_type = '{b}' THEN 1 ELSE 0 END" for b in ("regular", "irregular", "long_cycle", "one_time", "new")},
    "is_mobile_primary": "CASE WHEN mobile_session_ratio > 0.5 THEN 1 ELSE 0 END",
}
for _n, _v, _p in (("last_month", "month(last_seen)", 12), ("last_doy", "dayofyear(last_seen)", 365),
                   ("pref_dow", "preferred_day_of_week", 7), ("pref_hour", "preferred_hour_of_day", 24)):
    _SQL[f"{_n}_sin"], _SQL[f"{_n}_cos"] = f"sin(2 * pi() * {_v} / {_p})", f"cos(2 * pi() * {_v} / {_p})"

_FEATURES_SQL = """
l1top AS (SELECT * FROM (SELECT *, sum(engagement_score) OVER (PARTITION BY customer_id) AS total_score,
  row_number() OVER (PARTITION BY customer_id ORDER BY engagement_score DESC, first_engaged, category) AS rn FROM aff WHERE level = 1) WHERE rn = 1)"""


def features_sql(names, source: str) -> str:
    columns = ", ".join(f"round(CAST({_SQL.get(n, 'p.' + n)} AS DOUBLE), 6) AS {n}" for n in names)
    return with_(profiles_sql(source), _FEATURES_SQL, select=f"SELECT p.customer_id, {columns} FROM profiles p LEFT JOIN l1top t ON t.customer_id = p.customer_id")


for _group, _names in clv.FEATURES.items():
    query(f"clv_{_group}_features", features_sql(_names, "web"))(
        lambda spark, folder, n=_names: tidy(clv.build_features(web_profiles(spark, folder, leading=True), None, n)))

query("clv_feature_matrix", features_sql(clv.names_of(), "shop"))(
    lambda spark, folder: tidy(clv.build_features(shop_profiles(spark, folder, leading=True), None)))


@query("clv_regression_metrics", with_(profiles_sql("shop"), select="""
SELECT count(*) AS n, round(avg(abs(y - p)) / 1000, 6) AS mae, round(sqrt(avg((y - p) * (y - p))) / 1000, 6) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2,
  round(avg(abs((y - p) / y)) FILTER (WHERE y <> 0) * 100, 6) AS mape FROM (SELECT CAST(total_revenue AS DOUBLE) AS y, avg_order_value * 10 AS p FROM profiles)"""))
def clv_regression_metrics(spark, folder):
    rows = shop_profiles(spark, folder).select(F.col("total_revenue").cast("double").alias("target"), (F.col("avg_order_value") * 10).alias("prediction"))
    return tidy(clv.metrics(rows).withColumns({"mae": F.col("mae") / 1000, "rmse": F.col("rmse") / 1000}))


@query("clv_time_folds", with_(profiles_sql("shop"), select="""
SELECT CAST(f AS BIGINT) AS fold, count(*) AS customers FROM (SELECT (SELECT count(*) FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i) m JOIN pos q ON q.rn = n - (6 - i) * (n // 6) WHERE q.t <= x.t) AS f
FROM pos x) GROUP BY 1""").replace("SELECT CAST(f AS BIGINT) AS fold", ", pos AS (SELECT epoch_us(last_seen) AS t, row_number() OVER (ORDER BY last_seen) - 1 AS rn, count(*) OVER () AS n FROM profiles)\nSELECT CAST(f AS BIGINT) AS fold", 1))
def clv_time_folds(spark, folder):
    folds = clv.time_folds(shop_profiles(spark, folder).select("customer_id", "last_seen"))
    return folds.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("customers"))


_BETA = {"total_sessions": 120.5, "interval_mean": -3.25, "churn_risk_score": -5000.0, "category_count": 40.0}


@query("clv_linear_contributions", with_(profiles_sql("shop"), select=" UNION ALL ".join(
    f"SELECT customer_id, '{n}' AS feature, round({b} * (v - avg(v) OVER ()), 4) AS contribution FROM (SELECT customer_id, CAST(coalesce({n}, -1) AS DOUBLE) AS v FROM profiles)"
    for n, b in _BETA.items())))
def clv_linear_contributions(spark, folder):
    rows = cut(clv.build_features(shop_profiles(spark, folder, leading=True), None, tuple(_BETA)))
    found = clv.linear_contributions(rows, tuple(_BETA), tuple(_BETA.values()))
    return tidy(found.withColumn("contribution", F.round("contribution", 4)))


_MODELS = ("gradient_boosting", "random_forest", "ridge")


def _config(model: str) -> clv.TrainingConfig:
    return clv.TrainingConfig(model)


@query("clv_models")
def clv_models(spark, folder):
    out = None
    for model in _MODELS:
        _, found = clv.train(shop_profiles(spark, folder, leading=True), None, _config(model))
        row = found.withColumn("model", F.lit(model))
        out = row if out is None else out.unionByName(row)
    return out


# Ridge in SQL: centred columns as lists, their dot products as a matrix, Gauss-Jordan steps over it, one fold beside the other.
_RIDGE_NAMES = _config("ridge").names
_D = len(_RIDGE_NAMES)
_RIDGE_SQL = f"""
feats AS (SELECT p.customer_id, CAST(p.total_revenue AS DOUBLE) AS y, epoch_us(p.last_seen) AS seen_us, [{", ".join(f"CAST({_SQL.get(n, 'p.' + n)} AS DOUBLE)" for n in _RIDGE_NAMES)}] AS x
  FROM profiles p LEFT JOIN l1top t ON t.customer_id = p.customer_id),
ord AS (SELECT *, row_number() OVER (ORDER BY seen_us) - 1 AS rn, count(*) OVER () AS n FROM feats),
marks AS (SELECT seen_us AS mark FROM ord, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE rn = n - (6 - i) * (n // 6)),
placed AS (SELECT customer_id, y, x, (SELECT count(*) FROM marks WHERE mark <= ord.seen_us) AS fold FROM ord),
spread AS (SELECT k, j, customer_id, CASE WHEN j = {_D + 1} THEN y ELSE x[j] END AS v FROM placed, (SELECT unnest([1, 2, 3, 4, 5]) AS k), (SELECT unnest(range(1, {_D + 2})) AS j) WHERE fold < k),
mean AS (SELECT k, list(m ORDER BY j) AS centre FROM (SELECT k, j, avg(v) AS m FROM spread GROUP BY 1, 2) GROUP BY 1),
col AS (SELECT k, j, list(v - centre[j] ORDER BY customer_id) AS a FROM spread JOIN mean USING (k) GROUP BY 1, 2),
gram AS (SELECT k, p.j AS i, list(list_dot_product(p.a, q.a) + CASE WHEN p.j = q.j THEN 1.0 ELSE 0.0 END ORDER BY q.j) AS r FROM col p JOIN col q USING (k) WHERE p.j <= {_D} GROUP BY 1, 2),
elim AS (SELECT k, 0 AS s, list(r ORDER BY i) AS m FROM gram GROUP BY k
  UNION ALL SELECT k, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s + 1 THEN list_transform(r, lambda v: v / m[s + 1][s + 1])
    ELSE list_transform(list_zip(r, m[s + 1]), lambda z: z[1] - r[s + 1] * z[2] / m[s + 1][s + 1]) END) FROM elim WHERE s < {_D}),
beta AS (SELECT k, list_transform(m, lambda r: r[{_D + 1}]) AS b FROM elim WHERE s = {_D}),
guess AS (SELECT fold, y, centre[{_D + 1}] + list_dot_product(b, list_transform(list_zip(x, centre[1:{_D}]), lambda z: z[1] - z[2])) AS p
  FROM placed JOIN beta ON k = fold JOIN mean USING (k))
"""


@query("clv_cross_validation", with_(profiles_sql("shop"), _FEATURES_SQL, _RIDGE_SQL, select="""
SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, round(avg(abs(y - p)) / 1000, 4) AS mae, round(sqrt(avg((y - p) * (y - p))) / 1000, 4) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2,
  round(avg(abs((y - p) / y)) FILTER (WHERE y <> 0), 4) AS mape FROM guess GROUP BY 1"""))
def clv_cross_validation(spark, folder):
    config = _config("ridge")
    found = clv.cross_validate(clv.training_table(shop_profiles(spark, folder, leading=True), None, config), config)
    scale = {"mae": 1000, "rmse": 1000, "r2": 1, "mape": 100}
    return found.select("fold", "n", *[F.round(F.col(c) / d, 4).alias(c) for c, d in scale.items()])


@query("clv_holdout")
def clv_holdout(spark, folder):
    return clv.train_with_holdout(shop_profiles(spark, folder, leading=True), None, _config("random_forest"))[1]


@query("clv_importances")
def clv_importances(spark, folder):
    predictor, _ = clv.train(shop_profiles(spark, folder, leading=True), None, _config("random_forest"))
    return spark.createDataFrame(list(predictor.weights), "feature string, importance double")


def _predictions(spark, folder):
    predictor, _ = clv.train(shop_profiles(spark, folder, leading=True), None, _config("random_forest"))
    return predictor.predict(shop_profiles(spark, folder, leading=True), None)


@query("clv_predictions")
def clv_predictions(spark, folder):
    return _predictions(spark, folder).withColumn("top_features", F.array_join("top_features", "|"))


@query("clv_segments_with_predictions")
def clv_segments_with_predictions(spark, folder):
    rows = shop_profiles(spark, folder)
    valued = clustering.attach_predictions(rows, _predictions(spark, folder))
    return tidy(clustering.segment_rollup(clustering.with_segment(valued, members(rows, 5)), "segment_value"))


@query("clv_top_features", with_(profiles_sql("web"), select="""
SELECT customer_id, string_agg(name, '|' ORDER BY score DESC, name) AS top_features FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, name) AS rn FROM (
  SELECT customer_id, unnest(['total_purchases', 'total_sessions', 'total_page_views']) AS name, unnest([total_purchases * 0.5, total_sessions * 0.3, total_page_views * 0.2]) AS score FROM profiles)) WHERE rn <= 2 GROUP BY 1"""))
def clv_top_features(spark, folder):
    weights = (("total_purchases", 0.5), ("total_sessions", 0.3), ("total_page_views", 0.2))
    chosen = clv.Predictor(None, tuple(n for n, _ in weights), weights, "ridge").top_features(2)
    return web_profiles(spark, folder).select("customer_id", F.array_join(chosen, "|").alias("top_features"))


@query("clv_ablation_importance")
def clv_ablation_importance(spark, folder):
    predictor, _ = clv.train(shop_profiles(spark, folder, leading=True), None, _config("random_forest"))
    rows = clv.build_features(shop_profiles(spark, folder, leading=True), None, predictor.names)
    return clv.global_importance(clv.ablation_contributions(predictor.model, rows, predictor.names)).select(
        "feature", r6(F.col("importance")).alias("importance"))
