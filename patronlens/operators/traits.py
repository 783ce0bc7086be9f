"""Customer traits: named conditions over a profile, one row per customer and trait.

A rule is a condition and a value, both columns, so a user-defined trait is one
more `TraitRule` in the list and runs inside the same projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Terms that must not occur in a trait name.
TECHNICAL_TERMS = ("pca", "embedding", "latent", "component", "cluster_")


@dataclass(frozen=True)
class TraitRule:
    name: str
    dimension: str
    condition: Column
    value: Column

    def __post_init__(self) -> None:
        if any(term in self.name.lower() for term in TECHNICAL_TERMS):
            raise ValueError(f"trait name {self.name!r} contains technical wording")


def interval_behavior(regular_cv: float = 0.5, irregular_cv: float = 1.0, long_cycle_days: float = 90.0) -> Column:
    """Behaviour by interval length first, then by variation (a second, separate classifier)."""
    n, mean, cv = F.col("total_purchases"), F.col("interval_mean"), F.col("interval_cv")
    return (
        F.when(n == 0, "new").when(n == 1, "one_time")
        .when(mean.isNull() | cv.isNull(), "new")
        .when(mean > long_cycle_days, "long_cycle")
        .when(cv < regular_cv, "regular").when(cv < irregular_cv, "irregular").otherwise("long_cycle")
    )


def default_rules() -> list[TraitRule]:
    c = F.col
    yes = F.lit("true")

    def text(name: str) -> Column:
        return F.round(c(name), 6).cast("string")

    day = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), c("preferred_day_of_week") + 1)
    desktop = 1 - c("mobile_session_ratio")
    return [
        TraitRule("high_value_customer", "WHO", (c("clv_estimate") >= 500) | (c("total_revenue") >= 200), yes),
        TraitRule("churn_risk", "WHO", c("churn_risk_score") >= 0.6,
                  F.when(c("churn_risk_score") >= 0.8, "high").otherwise("moderate")),
        TraitRule("high_value_dormant", "WHO", (c("days_since_last_purchase") >= 60) & (c("total_revenue") >= 200), yes),
        TraitRule("cart_abandoner", "WHAT", (c("total_cart_additions") >= 2) & (c("cart_abandonment_rate") >= 0.5),
                  text("cart_abandonment_rate")),
        TraitRule("category_specialist", "WHAT", (c("top_score") >= 0.7) & (c("top_purchases") >= 2), c("top_category")),
        TraitRule("discount_sensitive", "WHAT", (c("total_purchases") >= 2) & (c("avg_order_value") <= 50)
                  & (c("purchase_frequency_per_month") >= 0.5), yes),
        TraitRule("browser_not_buyer", "WHAT", (c("total_items_viewed") >= 10) & (c("total_purchases") <= 1), yes),
        TraitRule("weekend_shopper", "WHEN", c("preferred_day_of_week").isin(5, 6), day),
        TraitRule("early_bird_shopper", "WHEN", c("preferred_hour_of_day") < 9, c("preferred_hour_of_day").cast("string")),
        TraitRule("night_owl_shopper", "WHEN", c("preferred_hour_of_day") >= 21, c("preferred_hour_of_day").cast("string")),
        TraitRule("seasonal_shopper", "WHEN", (c("tenure_days") >= 90) & (c("total_purchases") >= 2)
                  & (c("purchase_frequency_per_month") <= 0.3), yes),
        TraitRule("mobile_first", "HOW", c("mobile_session_ratio") >= 0.7, text("mobile_session_ratio")),
        TraitRule("desktop_loyalist", "HOW", desktop >= 0.8, F.round(desktop, 6).cast("string")),
        TraitRule("high_engagement", "HOW", (c("total_sessions") >= 10) & (c("total_page_views") >= 30), yes),
    ]


def behavior_rule() -> TraitRule:
    """Optional rule, not among the defaults: emitted for every customer."""
    return TraitRule("purchase_behavior_type", "WHO", F.lit(True), interval_behavior())


def with_top_affinity(profiles: DataFrame, affinity: DataFrame) -> DataFrame:
    """Score and purchases of each customer's first-ranked category."""
    order = F.struct((-F.col("engagement_score")).alias("s"), "first_engaged", "level", "category")
    top = affinity.groupBy("customer_id").agg(
        F.min_by(F.struct(F.col("engagement_score").alias("top_score"), F.col("purchase_count").alias("top_purchases")), order).alias("t"))
    return profiles.join(top.select("customer_id", "t.*"), "customer_id", "left")


def extract_traits(profiles: DataFrame, rules: Sequence[TraitRule] | None = None) -> DataFrame:
    """Rows (customer_id, trait, dimension, value) of every rule whose condition holds."""
    rules = default_rules() if rules is None else rules
    found = F.array_compact(F.array(*[
        F.when(r.condition, F.struct(F.lit(r.name).alias("trait"), F.lit(r.dimension).alias("dimension"),
                                     r.value.cast("string").alias("value")))
        for r in rules
    ]))
    return profiles.select("customer_id", F.inline(found))


def trait_totals(traits: DataFrame, profiles: DataFrame) -> DataFrame:
    """Customers per trait and their share of all customers."""
    everyone = profiles.agg(F.count("*").cast("double")).scalar()
    counts = traits.groupBy("trait", "dimension").agg(F.count("*").alias("customers"))
    return counts.withColumn("share", F.col("customers") / everyone)


def dimension_totals(traits: DataFrame) -> DataFrame:
    return traits.groupBy("dimension").agg(F.count("*").alias("traits"))


def traits_per_customer(traits: DataFrame, profiles: DataFrame) -> DataFrame:
    per = traits.groupBy("customer_id").agg(F.count("*").alias("n_traits"))
    return profiles.select("customer_id").join(per, "customer_id", "left").select(
        "customer_id", F.coalesce("n_traits", F.lit(0)).cast("bigint").alias("n_traits"))
