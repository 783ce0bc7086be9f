"""Data quality: field bounds, closed vocabularies and required fields as violation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.operators.traits import TECHNICAL_TERMS
from patronlens.sources.mapping import EVENT_TYPES

BEHAVIORS = ("regular", "irregular", "long_cycle", "new", "one_time")


def profile_rules() -> dict[str, Column]:
    """Rule name to the condition that marks a violating row."""
    c = F.col
    rules: dict[str, Column] = {"customer_id_required": c("customer_id").isNull() | (c("customer_id") == "")}
    for name in ("cart_abandonment_rate", "mobile_session_ratio", "churn_risk_score", "raw_refund_rate"):
        rules[f"{name}_in_unit_range"] = ~c(name).between(0.0, 1.0)
    for name in ("total_purchases", "total_revenue", "avg_order_value", "total_sessions", "clv_estimate", "total_refunds"):
        rules[f"{name}_not_negative"] = c(name) < 0
    rules["behavior_type_known"] = ~c("behavior_type").isin(*BEHAVIORS)
    rules["seen_in_order"] = c("first_seen") > c("last_seen")
    return rules


def event_rules() -> dict[str, Column]:
    c = F.col
    return {
        "customer_id_required": c("customer_id").isNull() | (c("customer_id") == ""),
        "ts_required": c("ts").isNull(),
        "event_type_known": ~c("event_type").isin(*EVENT_TYPES),
        "purchase_amount_present": (c("event_type") == "purchase") & c("total_amount").isNull() & c("order_total").isNull(),
        "amount_not_negative": F.coalesce("total_amount", "order_total") < 0,
    }


def violations(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows (rule, violations, checked): every rule is counted in the same pass."""
    totals = frame.agg(F.count("*").alias("checked"), *[F.count_if(bad).alias(name) for name, bad in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return totals.select("checked", F.inline(pairs)).select("rule", "violations", "checked")


def technical_wording(name: Column) -> Column:
    return F.lower(name).rlike("|".join(TECHNICAL_TERMS))
