"""Registered queries: scores, checks, gates and priorities of segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import profiles as profiles_sql, with_
from patronlens.functions.lineage import cut
from patronlens.operators import clustering, reports, scoring, stability
from patronlens.plans.registry import query
from patronlens.plans.report_queries import tidy
from patronlens.sources import retail
from patronlens.plans.segmentation_run import run
from patronlens.plans.segment_queries import ROBUST_SQL, SEGMENT_SQL, SENSITIVITY_SQL, described, members_sql, sensitivity
from patronlens.plans.whitespace_queries import SEGMENT_WHITESPACE_SQL, segment_values

GROUPS = 12

# Goals by a fixed rule, since segments carry none of their own.
_GOALS = {0: "reduce_churn", 1: "increase_revenue", 2: "increase_satisfaction"}


def segments(spark, folder, source="web", groups=GROUPS):
    """Described segments with goals, robustness and actionability, materialised once."""
    rows, members, found = described(spark, folder, source, groups)
    robust = stability.segment_robustness(clustering.with_segment(rows, members))
    number = F.regexp_extract("segment_id", r"_(\d+)$", 1).cast("int")
    goal = F.when(number % 4 == 0, _GOALS[0]).when(number % 4 == 1, _GOALS[1]).when(number % 4 == 2, _GOALS[2])
    joined = found.join(robust.select("segment_id", "feature_stability", "time_window_consistency", "overall_robustness", "robustness_tier"),
                        "segment_id")
    # every fifth segment has no robustness assessment
    unknown = number % 5 == 4
    joined = joined.withColumns({
        "strategic_goals": F.array_compact(F.array(goal)),
        **{c: F.when(~unknown, F.col(c)) for c in ("feature_stability", "time_window_consistency", "overall_robustness", "robustness_tier")},
    })
    return cut(scoring.evaluate_actionability(joined)), cut(rows.agg(F.count("*").alias("n")))



_MADE: dict = {}


def checked(spark, folder, source="web", groups=GROUPS):
    key = (spark.sparkContext.applicationId, folder, source, groups)
    if key not in _MADE:
        _MADE[key] = segments(spark, folder, source, groups)
    found, everyone = _MADE[key]
    return scoring.viability(found, everyone.scalar()), everyone


def _words(words) -> str:
    return "|".join(words)


def _any(words) -> str:
    return f"len(list_filter(traits, lambda t: regexp_matches(lower(t), '{_words(words)}'))) > 0"


SCORED_SQL = f"""
g0 AS (SELECT s.segment_id, s.size, s.total_clv, s.avg_clv, s.avg_order_value, s.traits, CAST(substr(s.segment_id, 9) AS INTEGER) AS num,
  CASE WHEN CAST(substr(s.segment_id, 9) AS INTEGER) % 5 <> 4 THEN r.feature_stability END AS feature_stability,
  CASE WHEN CAST(substr(s.segment_id, 9) AS INTEGER) % 5 <> 4 THEN r.time_window_consistency END AS time_window_consistency,
  CASE WHEN CAST(substr(s.segment_id, 9) AS INTEGER) % 5 <> 4 THEN r.overall_robustness END AS overall_robustness,
  CASE WHEN CAST(substr(s.segment_id, 9) AS INTEGER) % 5 <> 4 THEN r.robustness_tier END AS tier,
  (SELECT count(*) FROM profiles) AS everyone
  FROM seg s JOIN robust r USING (segment_id)),
g1 AS (SELECT *, CASE num % 4 WHEN 0 THEN 'reduce_churn' WHEN 1 THEN 'increase_revenue' WHEN 2 THEN 'increase_satisfaction' ELSE '' END AS goal,
  (CASE WHEN avg_clv > 100 THEN 1 ELSE 0 END + CASE WHEN avg_order_value > 100 THEN 1 ELSE 0 END + CASE WHEN size BETWEEN 10 AND 500 THEN 1 ELSE 0 END
   + CASE WHEN total_clv > 10000 THEN 1 ELSE 0 END) >= 2 AS who,
  {_any(scoring.PRODUCT_WORDS)} OR len(traits) >= 2 AS what, {_any(scoring.SCHEDULE_WORDS)} AS "when", {_any(scoring.CHANNEL_WORDS)} AS how,
  size * CAST(5 AS DOUBLE) AS campaign_cost, total_clv * CAST(0.1 AS DOUBLE) AS expected_uplift FROM g0),
g2 AS (SELECT *, list_filter([CASE WHEN who THEN 'WHO' END, CASE WHEN what THEN 'WHAT' END, CASE WHEN "when" THEN 'WHEN' END, CASE WHEN how THEN 'HOW' END], lambda x: x IS NOT NULL) AS dims,
  list_filter([CASE WHEN what THEN 'personalized_recommendations' END, CASE WHEN "when" THEN 'send_time_campaigns' END, CASE WHEN how THEN 'channel_messaging' END,
    CASE WHEN who THEN 'priority_outreach' END], lambda x: x IS NOT NULL) AS codes,
  expected_uplift * CAST(0.3 AS DOUBLE) - campaign_cost AS expected_profit FROM g1),
g3 AS (SELECT *, expected_profit / campaign_cost AS expected_roi, CASE WHEN total_clv > 0 THEN campaign_cost / total_clv ELSE 0.0 END AS cost_ratio,
  len(dims) >= 1 AND size >= 5 AND total_clv >= 100 AS is_actionable,
  CASE WHEN tier IS NULL THEN CASE WHEN size >= 50 AND len(dims) >= 2 THEN 'medium' ELSE 'low' END ELSE lower(tier) END AS actionability_confidence,
  CAST(least(1.0, greatest(0.0, 0.5 + CASE WHEN size BETWEEN 20 AND 500 THEN 0.2 WHEN size < 20 OR size > 1000 THEN -0.1 ELSE 0 END + CASE WHEN len(traits) > 0 THEN 0.2 ELSE 0 END
    + CASE WHEN len(dims) > 0 THEN 0.1 ELSE 0 END)) AS DOUBLE) AS marketing_targetability,
  CAST(least(1.0, CASE WHEN avg_clv > 500 THEN 0.4 WHEN avg_clv > 200 THEN 0.3 WHEN avg_clv > 100 THEN 0.2 ELSE 0.1 END + CASE WHEN total_clv > 50000 THEN 0.3 WHEN total_clv > 10000 THEN 0.2 ELSE 0.1 END
    + CASE WHEN size BETWEEN 10 AND 100 THEN 0.2 WHEN size <= 200 THEN 0.1 ELSE 0 END) AS DOUBLE) AS sales_prioritization,
  CAST(least(1.0, 0.3 + CASE WHEN what THEN 0.3 ELSE 0 END + CASE WHEN how THEN 0.2 ELSE 0 END + CASE WHEN len(traits) >= 2 THEN 0.2 ELSE 0 END) AS DOUBLE) AS personalization_opportunity,
  CAST(least(1.0, 0.2 + CASE WHEN "when" THEN 0.5 ELSE 0 END + CASE WHEN {_any(scoring.TIMING_WORDS)} THEN 0.3 ELSE 0 END) AS DOUBLE) AS timing_optimization FROM g2),
g4 AS (SELECT *, (marketing_targetability + sales_prioritization + personalization_opportunity + timing_optimization) / 4 AS avg_actionability FROM g3),
g5 AS (SELECT *, size >= 10 AND size <= 0.5 * everyone AS size_valid, total_clv >= 1000 AS value_valid, coalesce(overall_robustness >= 0.4, true) AS robustness_valid,
  len(dims) > 0 AS actionability_valid, expected_roi >= 0.5 AS economics_valid FROM g4),
g6 AS (SELECT *, size_valid AND value_valid AND robustness_valid AND actionability_valid AND economics_valid AS is_valid,
  list_filter([CASE WHEN size < 10 THEN 'too_small' END, CASE WHEN size > 0.5 * everyone THEN 'too_large' END, CASE WHEN NOT value_valid THEN 'low_total_value' END,
    CASE WHEN NOT robustness_valid THEN 'low_robustness' END, CASE WHEN len(dims) = 0 THEN 'no_actionability_dimensions' END, CASE WHEN NOT economics_valid THEN 'low_roi' END], lambda x: x IS NOT NULL) AS reasons,
  list_filter([CASE WHEN avg_clv < 50 THEN 'low_average_value' END, CASE WHEN overall_robustness IS NULL THEN 'no_robustness' END, CASE WHEN feature_stability < 0.3 THEN 'low_feature_stability' END,
    CASE WHEN time_window_consistency < 0.3 THEN 'low_time_consistency' END, CASE WHEN len(traits) = 0 THEN 'no_traits' END, CASE WHEN avg_actionability < 0.3 THEN 'low_actionability' END,
    CASE WHEN cost_ratio > 0.3 THEN 'high_cost_ratio' END], lambda x: x IS NOT NULL) AS warns FROM g5),
g7 AS (SELECT *, list_concat(list_filter(reasons, lambda x: x <> 'no_actionability_dimensions'), list_filter([CASE WHEN NOT is_actionable THEN 'not_actionable' END,
    CASE WHEN overall_robustness IS NULL THEN 'missing_robustness' WHEN overall_robustness < 0.3 THEN 'low_robustness_gate' END], lambda x: x IS NOT NULL)) AS gates FROM g6),
scored AS (SELECT *, len(gates) = 0 AS is_usable, least(100.0, CASE WHEN size >= 500 THEN 20 WHEN size >= 100 THEN 15 WHEN size >= 50 THEN 10 ELSE 5 END
  + CASE WHEN avg_clv >= 10000 THEN 25 WHEN avg_clv >= 5000 THEN 20 WHEN avg_clv >= 1000 THEN 15 ELSE 5 END + coalesce(overall_robustness * 20, 0) + least(expected_roi / 5, 1.0) * 15) AS priority_score FROM g7)
"""


def oracle(select: str, source: str = "web", groups: int = GROUPS) -> str:
    return with_(profiles_sql(source), members_sql(groups), ROBUST_SQL, SEGMENT_SQL, SCORED_SQL, select=select)


def _listed(frame):
    """Arrays as one text column."""
    return tidy(frame.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in frame.dtypes]))


def _register(name, sql, build, source="web", groups=GROUPS):
    query(name, oracle(sql, source, groups))(lambda spark, folder: _listed(build(*checked(spark, folder, source, groups))))


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_ROI = ("campaign_cost", "expected_uplift", "expected_profit", "expected_roi", "cost_ratio")
for _src, _n in (("web", GROUPS), ("shop", 30)):
    _register(f"segment_roi_{_src}", f"SELECT segment_id, {_round(*_ROI)} FROM scored", lambda f, _: f.select("segment_id", *_ROI), _src, _n)

for _score in ("marketing_targetability", "sales_prioritization", "personalization_opportunity", "timing_optimization"):
    _register(_score, f"SELECT segment_id, {_round(_score)} FROM scored", lambda f, _, s=_score: f.select("segment_id", s))

_register("segment_confidence", """SELECT segment_id, CASE WHEN tier IS NULL THEN CASE WHEN size >= 50 THEN 'medium' ELSE 'low' END ELSE lower(tier) END AS confidence_level FROM scored""",
          lambda f, _: f.select("segment_id", scoring.confidence(F.col("robustness_tier"), F.col("size")).alias("confidence_level")))
_register("strategic_impact", """SELECT segment_id, CASE WHEN total_clv > 100000 THEN 'high' WHEN total_clv > 25000 THEN 'medium' ELSE 'low' END AS revenue_impact,
  CASE WHEN goal = 'reduce_churn' AND size > 20 THEN 'high' WHEN goal = 'reduce_churn' THEN 'medium' ELSE 'low' END AS retention_impact,
  CASE WHEN goal = 'increase_satisfaction' THEN 'medium' ELSE 'low' END AS satisfaction_impact FROM scored""",
          lambda f, _: f.select("segment_id", "revenue_impact", "retention_impact", "satisfaction_impact"))
for _check in ("size", "value", "robustness", "actionability", "economics"):
    _register(f"segment_{_check}_check", f"SELECT segment_id, {_check}_valid FROM scored", lambda f, _, c=_check: f.select("segment_id", f"{c}_valid"))
_register("segment_validation", """SELECT segment_id, is_valid, array_to_string(reasons, '|') AS rejection_reasons, array_to_string(warns, '|') AS warnings,
  round(avg_actionability, 6) AS avg_actionability, round(coalesce(overall_robustness, 0.5), 6) AS robustness_score FROM scored""",
          lambda f, _: f.select("segment_id", "is_valid", "rejection_reasons", "warnings", "avg_actionability", "robustness_score"))
_register("segment_viability", """SELECT segment_id, size, round(total_clv, 6) AS total_clv, round(campaign_cost, 6) AS cost_to_exploit, round(expected_roi, 6) AS expected_roi,
  lower(coalesce(tier, 'MEDIUM')) AS confidence_level, CASE WHEN len(codes) > 0 THEN array_to_string(codes, '|') ELSE 'review_segment' END AS recommended_actions, is_valid AS is_approved FROM scored""",
          lambda f, _: f.select("segment_id", "size", "total_clv", "cost_to_exploit", "expected_roi", "confidence_level", "recommended_actions", "is_approved"))
for _dim in ("who", "what", "when", "how"):
    _register(f"dimension_{_dim}", f'SELECT segment_id, "{_dim}" FROM scored', lambda f, _, d=_dim: f.select("segment_id", d))
_register("segment_actionability", """SELECT segment_id, is_actionable, actionability_confidence, array_to_string(dims, '|') AS actionability_dimensions,
  CASE WHEN is_actionable THEN array_to_string(codes, '|') END AS actions FROM scored""",
          lambda f, _: f.select("segment_id", "is_actionable", "actionability_confidence", "actionability_dimensions", "actions"))
_register("actionable_segments", """SELECT segment_id FROM scored WHERE is_actionable AND len(dims) >= 3 AND actionability_confidence IN ('medium', 'high')""",
          lambda f, _: scoring.filter_actionable(f, 3, "medium").select("segment_id"))
_register("production_ready_segments", "SELECT segment_id FROM scored WHERE is_valid AND is_actionable",
          lambda f, _: scoring.production_ready(f).select("segment_id"))
_register("key_characteristics", """SELECT segment_id, array_to_string(list_filter(list_concat([CASE WHEN avg_clv > 500 THEN 'premium_value' WHEN avg_clv > 200 THEN 'high_value' WHEN avg_clv > 100 THEN 'moderate_value' END,
    CASE WHEN avg_order_value > 150 THEN 'high_order_value' WHEN avg_order_value > 75 THEN 'moderate_order_value' END,
    CASE WHEN size > 500 THEN 'large_segment' WHEN size > 100 THEN 'medium_segment' ELSE 'focused_segment' END], traits[1:3],
    [CASE goal WHEN 'reduce_churn' THEN 'churn_mitigation' WHEN 'increase_revenue' THEN 'revenue_growth' WHEN 'increase_satisfaction' THEN 'satisfaction_focus' END]), lambda x: x IS NOT NULL)[1:5], '|') AS characteristics FROM scored""",
          lambda f, _: f.select("segment_id", scoring.key_characteristics(f).alias("characteristics")))
_register("campaign_components", """SELECT segment_id, array_to_string(list_filter(list_concat(codes, [CASE goal WHEN 'reduce_churn' THEN 'retention_incentives' WHEN 'increase_revenue' THEN 'upsell_and_cross_sell' END]), lambda x: x IS NOT NULL), '|') AS components FROM scored""",
          lambda f, _: f.select("segment_id", scoring.campaign_components(f).alias("components")))
_register("usability_gates", "SELECT segment_id, is_usable, array_to_string(gates, '|') AS usability_reasons FROM scored",
          lambda f, _: scoring.usability(f).select("segment_id", "is_usable", "usability_reasons"))
_POINTS = "CASE WHEN w >= 100000 THEN 20 WHEN w >= 50000 THEN 15 WHEN w >= 10000 THEN 10 WHEN w > 0 THEN 5 ELSE 0 END"
# without whitespace a score stays below 100, so the limit is applied once, here
_VALUED_SQL = f"""
valued AS (SELECT * REPLACE (least(100.0, priority_score + {_POINTS}) AS priority_score) FROM (
  SELECT scored.*, coalesce(whitespace_value, 0.0) AS w FROM scored LEFT JOIN segopp USING (segment_id)))"""


def _register_valued(name, sql, build, groups):
    """Queries that need the whitespace of each segment: on the shop, whose categories have buyers and lookalikes."""
    text = with_(profiles_sql("shop"), members_sql(groups), ROBUST_SQL, SEGMENT_SQL, SCORED_SQL, *SEGMENT_WHITESPACE_SQL, _VALUED_SQL, select=sql)

    def run_query(spark, folder):
        found, everyone = checked(spark, folder, "shop", groups)
        valued = found.join(segment_values(spark, folder, groups), "segment_id", "left").withColumn("whitespace_value", F.coalesce("whitespace_value", F.lit(0.0)))
        return _listed(build(valued, everyone))

    query(name, text)(run_query)


_register_valued("segment_priority", "SELECT segment_id, round(priority_score, 6) AS priority_score, round(w, 2) AS whitespace_value FROM valued",
                 lambda f, _: scoring.priority(f).select("segment_id", "priority_score", F.round("whitespace_value", 2).alias("whitespace_value")), 12)
_register_valued("top_usable_segments", "SELECT segment_id, round(priority_score, 6) AS priority_score FROM valued WHERE is_usable ORDER BY valued.priority_score DESC, segment_id LIMIT 5",
                 lambda f, _: scoring.top_segments(scoring.priority(scoring.usability(f))).select("segment_id", "priority_score"), 30)
_register_valued("integrated_totals", """SELECT count(*) AS segments, count(*) FILTER (WHERE is_usable) AS usable, count(*) FILTER (WHERE NOT is_usable) AS rejected,
  CAST(coalesce(sum(size) FILTER (WHERE is_usable), 0) AS BIGINT) AS customers_in_usable, round(coalesce(sum(round(total_clv, 2)) FILTER (WHERE is_usable), 0.0), 2) AS usable_clv,
  round(coalesce(sum(w) FILTER (WHERE is_usable), 0.0), 2) AS whitespace_value, max(everyone) AS total_customers, round(count(*) FILTER (WHERE is_usable) / CAST(count(*) AS DOUBLE), 6) AS usability_rate,
  round(coalesce(sum(size) FILTER (WHERE is_usable), 0) / CAST(max(everyone) AS DOUBLE), 6) AS customer_coverage FROM valued""",
                 lambda f, n: scoring.integrated_totals(scoring.usability(f), n.scalar()).withColumns({c: F.round(c, 2) for c in ("usable_clv", "whitespace_value")}), 30)
_register("segment_report_rows", """SELECT segment_id, size, robustness_tier, is_actionable, expected_roi FROM (SELECT segment_id, size, tier AS robustness_tier, is_actionable, round(expected_roi, 6) AS expected_roi FROM scored)""",
          lambda f, _: scoring.report_rows(f.select("segment_id", "size"), f.where("robustness_tier IS NOT NULL").select("segment_id", "robustness_tier"),
                                           f.select("segment_id", "is_actionable"), f.select("segment_id", "expected_roi")))
_register("segment_report_totals", """SELECT count(*) AS segments, CAST(sum(size) AS BIGINT) AS customers, round(sum(total_clv), 2) AS total_clv, round(avg(size), 6) AS avg_segment_size, round(avg(total_clv), 2) AS avg_segment_clv,
  count(*) FILTER (WHERE is_actionable) AS actionable, round(avg(CASE WHEN is_actionable THEN 1.0 ELSE 0.0 END), 6) AS actionability_rate,
  count(*) FILTER (WHERE tier = 'HIGH') AS high_robustness, count(*) FILTER (WHERE tier = 'MEDIUM') AS medium_robustness, count(*) FILTER (WHERE tier = 'LOW') AS low_robustness FROM scored""",
          lambda f, _: scoring.report_totals(f).withColumns({c: F.round(c, 2) for c in ("total_clv", "avg_segment_clv")}))
_register("segment_dimension_distribution", "SELECT d AS dimension, count(*) AS segments FROM (SELECT unnest(dims) AS d FROM scored) GROUP BY 1",
          lambda f, _: scoring.dimension_distribution(f))
_register("validation_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS rejected,
  round(avg(CASE WHEN is_valid THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM scored""", lambda f, _: scoring.validation_summary(f))
_register("rejection_counts", "SELECT r AS reason, count(*) AS segments FROM (SELECT unnest(reasons) AS r FROM scored) GROUP BY 1",
          lambda f, _: scoring.rejection_counts(f))
_register("explanation_confidence", """SELECT CASE tier WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low' ELSE 'medium' END AS confidence, count(*) AS segments FROM scored GROUP BY 1""",
          lambda f, _: f.groupBy(scoring.explanation_confidence(F.col("robustness_tier")).alias("confidence")).agg(F.count("*").alias("segments")))
_register("run_metrics", """SELECT count(*) AS segments, count(*) FILTER (WHERE is_valid) AS valid_segments, count(*) FILTER (WHERE is_actionable) AS actionable_segments,
  count(*) FILTER (WHERE is_valid AND is_actionable) AS production_ready_segments, max(everyone) AS profiles FROM scored""",
          lambda f, n: scoring.run_metrics(n, f).withColumn("profiles", n.scalar()))

_register("robustness_report", """SELECT count(*) AS segments, count(*) FILTER (WHERE tier = 'HIGH') AS high, count(*) FILTER (WHERE tier = 'MEDIUM') AS medium, count(*) FILTER (WHERE tier = 'LOW') AS low,
  round(avg(CASE WHEN tier = 'HIGH' THEN 1.0 ELSE 0.0 END) * 100, 6) AS high_share, round(avg(feature_stability), 6) AS avg_feature_stability,
  round(avg(time_window_consistency), 6) AS avg_time_consistency FROM scored WHERE tier IS NOT NULL""",
          lambda f, _: reports.robustness_report(f.where("robustness_tier IS NOT NULL")))

@query("critical_feature_report", with_(profiles_sql("web"), members_sql(GROUPS), ROBUST_SQL, SEGMENT_SQL, SCORED_SQL, *SENSITIVITY_SQL, select=f"""
SELECT grp AS feature, count(*) AS segments, round(avg(feature_stability), 6) AS avg_stability
FROM scored, (SELECT grp FROM ari WHERE ari < {stability.CRITICAL_ARI}) WHERE tier IS NOT NULL GROUP BY 1"""))
def critical_feature_report(spark, folder):
    """Features without which the population falls into other clusters, and the segments assessed under them."""
    found, _ = checked(spark, folder)
    critical = sensitivity(spark, folder).where("is_critical").agg(F.array_sort(F.collect_list("dropped_feature"))).scalar()
    assessed = found.where("robustness_tier IS NOT NULL").select("feature_stability", critical.alias("critical_features"))
    return _listed(reports.critical_features(assessed))


@query("prioritised_segments")
def prioritised_segments(spark, folder):
    tables = run(retail.web_events(spark, folder), retail.web_id_history(spark, folder), retail.instant(retail.WEB_REFERENCE), k=4)
    return tables["segments"].select("segment_id", "name", "size", "total_clv", "is_valid", "is_actionable", "is_usable", "priority_score",
                                     F.array_join("usability_reasons", "|").alias("usability_reasons"), "whitespace_value")
