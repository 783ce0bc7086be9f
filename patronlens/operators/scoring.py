"""Segment scores, checks and priorities as columns over one row per group.

The group may be any key (cluster, cohort, category, campaign): nothing here
depends on the number of groups, and every function adds columns in one pass.

Expected columns: segment_id, size, total_clv, avg_clv, avg_order_value,
defining_traits, actionability_dimensions and strategic_goals (arrays of text),
and optionally the robustness columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.functions.columns import any_matches, clamp, compact_labels, ratio

# Words that mark a trait as timing, product, schedule or channel related.
TIMING_WORDS = ("weekend", "morning", "evening", "night", "seasonal", "early", "late")
PRODUCT_WORDS = ("category", "product", "preference", "affinity", "interest")
SCHEDULE_WORDS = ("weekend", "weekday", "morning", "evening", "night", "seasonal", "early", "late", "time", "hour", "day")
CHANNEL_WORDS = ("mobile", "desktop", "device", "channel", "email", "sms", "push", "app", "web", "browser")
# Action codes per dimension, in the order they are listed.
ACTIONS = (("WHAT", "personalized_recommendations"), ("WHEN", "send_time_campaigns"), ("HOW", "channel_messaging"), ("WHO", "priority_outreach"))
DIMENSIONS_REASON = "no_actionability_dimensions"
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}


@dataclass(frozen=True)
class Criteria:
    min_size: int = 10
    max_share: float = 0.5
    min_total_clv: float = 1000.0
    min_avg_clv: float = 50.0
    min_feature_stability: float = 0.3
    min_time_consistency: float = 0.3
    min_robustness: float = 0.4
    min_roi: float = 0.5
    max_cost_ratio: float = 0.3
    require_dimension: bool = True
    min_actionability: float = 0.3
    cost_per_customer: float = 5.0
    conversion_lift: float = 0.1
    margin: float = 0.3


def ready(segments: DataFrame) -> DataFrame:
    """Missing optional inputs as typed nulls or empty lists."""
    defaults = {
        "strategic_goals": F.array().cast("array<string>"), "actionability_dimensions": F.array().cast("array<string>"),
        **{c: F.lit(None).cast("double") for c in ("overall_robustness", "feature_stability", "time_window_consistency")},
        "robustness_tier": F.lit(None).cast("string"),
    }
    return segments.withColumns({n: v for n, v in defaults.items() if n not in segments.columns})


def economics(segments: DataFrame, rules: Criteria = Criteria(), complexity: float = 1.0) -> DataFrame:
    """Campaign cost, expected uplift, profit, return on investment and cost ratio."""
    cost = F.col("size") * F.lit(rules.cost_per_customer)
    uplift = F.col("total_clv") * F.lit(rules.conversion_lift)
    profit = uplift * F.lit(rules.margin) - cost
    empty = F.col("size") == 0
    return segments.withColumns({
        "campaign_cost": cost, "expected_uplift": F.when(empty, 0.0).otherwise(uplift), "expected_profit": F.when(empty, 0.0).otherwise(profit),
        "expected_roi": ratio(profit, cost), "cost_ratio": F.when(F.col("total_clv") > 0, ratio(cost, F.col("total_clv"))).otherwise(0.0),
        "cost_to_exploit": cost * F.lit(complexity),
    })


def _has(dimension: str) -> Column:
    return F.array_contains("actionability_dimensions", dimension)


def _goal(name: str) -> Column:
    return F.array_contains("strategic_goals", name)


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(0.0)


def usefulness(segments: DataFrame) -> DataFrame:
    """Targetability, sales priority, personalisation and timing scores in [0, 1]."""
    size, total, average = F.col("size"), F.col("total_clv"), F.col("avg_clv")
    traits = F.col("defining_traits")
    by_size = F.when(size.between(20, 500), 0.2).when((size < 20) | (size > 1000), -0.1).otherwise(0.0)
    targetability = clamp(0.5 + by_size + _points(F.size(traits) > 0, 0.2) + _points(F.size("actionability_dimensions") > 0, 0.1))
    sales = (
        F.when(average > 500, 0.4).when(average > 200, 0.3).when(average > 100, 0.2).otherwise(0.1)
        + F.when(total > 50000, 0.3).when(total > 10000, 0.2).otherwise(0.1)
        + F.when(size.between(10, 100), 0.2).when(size <= 200, 0.1).otherwise(0.0))
    personal = clamp(0.3 + _points(_has("WHAT"), 0.3) + _points(_has("HOW"), 0.2) + _points(F.size(traits) >= 2, 0.2))
    timing = clamp(0.2 + _points(_has("WHEN"), 0.5) + _points(any_matches(traits, TIMING_WORDS), 0.3))
    scored = segments.withColumns({
        "marketing_targetability": targetability, "sales_prioritization": F.when(size == 0, 0.0).otherwise(clamp(sales)),
        "personalization_opportunity": personal, "timing_optimization": timing,
    })
    parts = ("marketing_targetability", "sales_prioritization", "personalization_opportunity", "timing_optimization")
    return scored.withColumn("avg_actionability", sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / 4)


def confidence(tier: Column, size: Column) -> Column:
    """From the robustness tier, or from the size where there is none."""
    return F.when(tier.isNull(), F.when(size >= 50, "medium").otherwise("low")).otherwise(F.lower(tier))


def strategic_impact(segments: DataFrame) -> DataFrame:
    total = F.col("total_clv")
    churn = _goal("reduce_churn")
    return segments.withColumns({
        "revenue_impact": F.when(total > 100000, "high").when(total > 25000, "medium").otherwise("low"),
        "retention_impact": F.when(churn & (F.col("size") > 20), "high").when(churn, "medium").otherwise("low"),
        "satisfaction_impact": F.when(_goal("increase_satisfaction"), "medium").otherwise("low"),
    })


def validate(segments: DataFrame, total_customers: Column, rules: Criteria = Criteria()) -> DataFrame:
    """Size, value, robustness, actionability and economics checks with reason and warning codes."""
    base = usefulness(economics(ready(segments), rules))
    c = F.col
    share = ratio(c("size"), total_customers)
    known = c("overall_robustness").isNotNull()
    size_ok = (c("size") >= rules.min_size) & (share <= rules.max_share)
    value_ok = c("total_clv") >= rules.min_total_clv
    robust_ok = ~known | (c("overall_robustness") >= rules.min_robustness)
    usable = F.lit(True) if not rules.require_dimension else F.size("actionability_dimensions") > 0
    pays = c("expected_roi") >= rules.min_roi
    return base.withColumns({
        "size_valid": size_ok, "value_valid": value_ok, "robustness_valid": robust_ok, "actionability_valid": usable, "economics_valid": pays,
        "robustness_score": F.coalesce(c("overall_robustness"), F.lit(0.5)),
        "is_valid": size_ok & value_ok & robust_ok & usable & pays,
        "rejection_reasons": compact_labels(
            F.when(c("size") < rules.min_size, "too_small"), F.when(share > rules.max_share, "too_large"),
            F.when(~value_ok, "low_total_value"), F.when(~robust_ok, "low_robustness"),
            F.when(~usable, DIMENSIONS_REASON), F.when(~pays, "low_roi")),
        "warnings": compact_labels(
            F.when(c("avg_clv") < rules.min_avg_clv, "low_average_value"), F.when(~known, "no_robustness"),
            F.when(c("feature_stability") < rules.min_feature_stability, "low_feature_stability"),
            F.when(c("time_window_consistency") < rules.min_time_consistency, "low_time_consistency"),
            F.when(F.size("defining_traits") == 0, "no_traits"),
            F.when(c("avg_actionability") < rules.min_actionability, "low_actionability"),
            F.when(c("cost_ratio") > rules.max_cost_ratio, "high_cost_ratio")),
    })


def action_codes(dimensions: Column) -> Column:
    return compact_labels(*[F.when(F.array_contains(dimensions, d), code) for d, code in ACTIONS])


def evaluate_dimensions(segments: DataFrame) -> DataFrame:
    """WHO, WHAT, WHEN and HOW flags from values and trait wording."""
    size, traits = F.col("size"), F.col("defining_traits")
    points = [F.col("avg_clv") > 100, F.col("avg_order_value") > 100, size.between(10, 500), F.col("total_clv") > 10000]
    who = sum((p.cast("int") for p in points[1:]), points[0].cast("int")) >= 2
    flagged = segments.withColumns({
        "who": who, "what": any_matches(traits, PRODUCT_WORDS) | (F.size(traits) >= 2),
        "when": any_matches(traits, SCHEDULE_WORDS), "how": any_matches(traits, CHANNEL_WORDS),
    })
    return flagged.withColumn("actionability_dimensions", compact_labels(
        F.when(F.col("who"), "WHO"), F.when(F.col("what"), "WHAT"), F.when(F.col("when"), "WHEN"), F.when(F.col("how"), "HOW")))


def evaluate_actionability(segments: DataFrame, min_dimensions: int = 1) -> DataFrame:
    """Actionable or not, confidence and action codes; a missing evaluation has no confidence."""
    flagged = evaluate_dimensions(ready(segments))
    dims, size, tier = F.size("actionability_dimensions"), F.col("size"), F.col("robustness_tier")
    ok = (dims >= min_dimensions) & (size >= 5) & (F.col("total_clv") >= 100)
    by_size = F.when((size >= 50) & (dims >= 2), "medium").otherwise("low")
    return flagged.withColumns({
        "is_actionable": ok, "actionability_confidence": F.when(tier.isNull(), by_size).otherwise(F.lower(tier)),
        "actions": F.when(ok, action_codes(F.col("actionability_dimensions"))),
        "blockers": compact_labels(F.when(F.col("total_clv") < 100, "insufficient_value"), F.when(size < 5, "too_small_to_target")),
    })


def filter_actionable(evaluated: DataFrame, min_dimensions: int = 1, min_confidence: str = "low") -> DataFrame:
    ranks = F.create_map(*[F.lit(x) for pair in CONFIDENCE_RANK.items() for x in pair])
    return evaluated.where(
        F.col("is_actionable") & (F.size("actionability_dimensions") >= min_dimensions)
        & (ranks[F.col("actionability_confidence")] >= CONFIDENCE_RANK[min_confidence]))


def viability(segments: DataFrame, total_customers: Column, rules: Criteria = Criteria()) -> DataFrame:
    """Scores, cost, impacts, confidence and approval of every segment."""
    checked = strategic_impact(validate(segments, total_customers, rules))
    # without robustness the record assumes 0.5 for both parts, which is the medium tier
    tier = F.coalesce(F.col("robustness_tier"), F.lit("MEDIUM"))
    codes = action_codes(F.col("actionability_dimensions"))
    return checked.withColumns({
        "confidence_level": confidence(tier, F.col("size")),
        "recommended_actions": F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("review_segment"))),
        "is_approved": F.col("is_valid"),
    })


def key_characteristics(segments: DataFrame) -> Column:
    """Up to five labels from value, order value, size, traits and goals."""
    c = F.col
    fixed = F.array(
        F.when(c("avg_clv") > 500, "premium_value").when(c("avg_clv") > 200, "high_value").when(c("avg_clv") > 100, "moderate_value"),
        F.when(c("avg_order_value") > 150, "high_order_value").when(c("avg_order_value") > 75, "moderate_order_value"),
        F.when(c("size") > 500, "large_segment").when(c("size") > 100, "medium_segment").otherwise("focused_segment"))
    goals = F.transform("strategic_goals", lambda g: F.when(g == "reduce_churn", "churn_mitigation").when(
        g == "increase_revenue", "revenue_growth").when(g == "increase_satisfaction", "satisfaction_focus"))
    return F.slice(F.array_compact(F.concat(fixed, F.slice("defining_traits", 1, 3), goals)), 1, 5)


def campaign_components(segments: DataFrame) -> Column:
    goal = F.when(_goal("reduce_churn"), "retention_incentives").when(_goal("increase_revenue"), "upsell_and_cross_sell")
    return F.array_compact(F.concat(action_codes(F.col("actionability_dimensions")), F.array(goal)))


def explanation_confidence(tier: Column) -> Column:
    return F.when(tier == "HIGH", "high").when(tier == "LOW", "low").otherwise("medium")


def usability(segments: DataFrame, min_robustness: float = 0.3) -> DataFrame:
    """Quality gates over validated and evaluated segments; the missing-dimensions reason is ignored here."""
    rejections = F.filter("rejection_reasons", lambda r: r != DIMENSIONS_REASON)
    invalid = F.when(F.col("is_valid").isNull(), F.array(F.lit("not_validated"))).otherwise(rejections)
    blocked = compact_labels(
        F.when(~F.coalesce("is_actionable", F.lit(False)), "not_actionable"),
        F.when(F.col("overall_robustness").isNull(), "missing_robustness").when(F.col("overall_robustness") < min_robustness, "low_robustness_gate"))
    reasons = F.concat(invalid, blocked)
    return segments.withColumn("usability_reasons", reasons).withColumn("is_usable", F.size("usability_reasons") == 0)


def priority(segments: DataFrame) -> DataFrame:
    """Priority from 0 to 100; a negative return on investment lowers it."""
    size, average, value = F.col("size"), F.col("avg_clv"), F.coalesce("whitespace_value", F.lit(0.0))
    score = (
        F.when(size >= 500, 20).when(size >= 100, 15).when(size >= 50, 10).otherwise(5)
        + F.when(average >= 10000, 25).when(average >= 5000, 20).when(average >= 1000, 15).otherwise(5)
        + F.coalesce(F.col("overall_robustness") * 20, F.lit(0.0))
        + F.when(F.col("expected_roi").isNull(), 0.0).otherwise(F.least(F.col("expected_roi") / 5.0, F.lit(1.0)) * 15)
        + F.when(value >= 100000, 20).when(value >= 50000, 15).when(value >= 10000, 10).when(value > 0, 5).otherwise(0))
    return segments.withColumn("priority_score", F.least(F.lit(100.0), score))


def top_segments(usable: DataFrame, n: int = 5) -> DataFrame:
    return usable.where("is_usable").orderBy(F.desc("priority_score"), "segment_id").limit(n)


def integrated_totals(usable: DataFrame, total_customers: Column) -> DataFrame:
    ok = F.col("is_usable")
    return usable.agg(
        F.count("*").alias("segments"), F.count_if(ok).alias("usable"), F.count_if(~ok).alias("rejected"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("customers_in_usable"),
        F.coalesce(F.sum(F.when(ok, F.col("total_clv"))), F.lit(0.0)).alias("usable_clv"),
        F.coalesce(F.sum(F.when(ok, F.col("whitespace_value"))), F.lit(0.0)).alias("whitespace_value"),
    ).withColumn("total_customers", total_customers).withColumns({
        "usability_rate": ratio(F.col("usable"), F.col("segments")),
        "customer_coverage": ratio(F.col("customers_in_usable"), F.col("total_customers")),
    })


def production_ready(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("is_valid") & F.col("is_actionable"))


def report_rows(segments: DataFrame, *assessments: DataFrame) -> DataFrame:
    """Segments with every assessment attached on segment_id; a missing one leaves nulls."""
    out = segments
    for part in assessments:
        out = out.join(part, "segment_id", "left")
    return out


def report_totals(rows: DataFrame) -> DataFrame:
    tier = F.col("robustness_tier")
    return rows.agg(
        F.count("*").alias("segments"), F.sum("size").alias("customers"), F.sum("total_clv").alias("total_clv"),
        F.avg("size").alias("avg_segment_size"), F.avg("total_clv").alias("avg_segment_clv"),
        F.count_if(F.col("is_actionable")).alias("actionable"), F.avg(F.col("is_actionable").cast("double")).alias("actionability_rate"),
        *[F.count_if(tier == t).alias(f"{t.lower()}_robustness") for t in ("HIGH", "MEDIUM", "LOW")])


def dimension_distribution(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("actionability_dimensions").alias("dimension")).groupBy("dimension").agg(F.count("*").alias("segments"))


def validation_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("rejected"),
        F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)).alias("pass_rate"))


def rejection_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("segments"))


def run_metrics(profiles: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counts for a whole run; stage timings are in the Spark UI."""
    return rows.agg(
        F.count("*").alias("segments"), F.count_if("is_valid").alias("valid_segments"), F.count_if("is_actionable").alias("actionable_segments"),
        F.count_if(F.col("is_valid") & F.col("is_actionable")).alias("production_ready_segments"),
    ).withColumn("profiles", profiles.agg(F.count("*")).scalar())
