"""Report datasets over profiles: loyalty, champions, first purchases, churn, categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.columns import money_avg, money_sum, ratio

# The behaviours of the flow chart and their column.
FLOW_NODES = (("regular", 1), ("irregular", 1), ("long_cycle", 1), ("new", 0), ("one_time", 1))


def behavior_shares(profiles: DataFrame) -> DataFrame:
    """Customers, share and average purchases per behaviour."""
    counts = profiles.groupBy("behavior_type").agg(
        F.count("*").alias("customers"), F.avg("total_purchases").alias("avg_orders"))
    everyone = profiles.agg(F.count("*").cast("double")).scalar()
    return counts.withColumn("share", F.col("customers") / everyone).withColumn(
        "is_champion", F.col("behavior_type") == "regular")


def order_histogram(profiles: DataFrame, cap: int = 10) -> DataFrame:
    """Customers and retention per purchase count; counts above the last bucket share it."""
    kept = (~F.col("behavior_type").isin("one_time", "new")).cast("double")
    return profiles.groupBy(F.least("total_purchases", F.lit(cap)).cast("bigint").alias("orders")).agg(
        F.count("*").alias("customers"), F.avg(kept).alias("retention"))


def loyalty_threshold(histogram: DataFrame) -> DataFrame:
    """Bucket with the largest retention gain over the bucket before it; ties go to the smaller one.

    The window has no partition but runs over at most `cap + 1` histogram rows.
    """
    order = Window.orderBy("orders")
    steps = histogram.withColumn("jump", F.col("retention") - F.lag("retention", 1, 0.0).over(order))
    best = F.max_by(F.struct("orders", "jump"), F.when(F.col("jump") > 0, F.struct("jump", -F.col("orders"))))
    return steps.agg(best.alias("b"), F.count("*").alias("n")).select(
        F.when((F.col("n") > 1) & F.col("b").isNotNull(), F.col("b.orders")).otherwise(F.lit(1)).cast("bigint").alias("threshold_order"),
        F.when((F.col("n") > 1) & F.col("b").isNotNull(), F.col("b.jump")).otherwise(F.lit(0.0)).alias("retention_jump"))


def behavior_flow(profiles: DataFrame) -> DataFrame:
    """Links of the loyalty flow with at least one customer."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("behavior_type") == kind)

    links = [(F.lit("new"), F.lit(t), F.col(t)) for t in ("one_time", "irregular", "regular", "long_cycle")]
    links.append((F.lit("irregular"), F.lit("regular"), F.floor(F.col("regular") * F.lit(0.3)).cast("bigint")))
    rows = F.array(*[F.struct(s.alias("source"), t.alias("target"), v.alias("value")) for s, t, v in links])
    totals = profiles.agg(*[n(k).alias(k) for k in ("one_time", "irregular", "regular", "long_cycle")])
    return totals.select(F.inline(rows)).where(F.col("value") > 0)


def flow_nodes(profiles: DataFrame) -> DataFrame:
    """Node id, label, column and customer count of the loyalty flow."""
    nodes = F.array(*[
        F.struct(F.lit(k).alias("id"), F.lit(k.replace("_", " ").title()).alias("name"), F.lit(g).cast("bigint").alias("group_index"),
                 F.col(k).alias("customers"))
        for k, g in FLOW_NODES])
    totals = profiles.agg(*[F.count_if(F.col("behavior_type") == k).alias(k) for k, _ in FLOW_NODES])
    return totals.select(F.inline(nodes))


def first_seen_cohorts(profiles: DataFrame) -> DataFrame:
    """Behaviour counts per month of first activity."""
    return profiles.groupBy(F.date_format("first_seen", "yyyy-MM").alias("cohort"), "behavior_type").agg(F.count("*").alias("customers"))


def order_statistics(
    frame: DataFrame, column: str, fractions: dict[str, tuple[int, int]], accuracy: int = 20_000, position: Callable[[Column, int, int], Column] | None = None,
) -> DataFrame:
    """Value at 0-based position floor(a*n/b) of the sorted column, exactly, as one row.

    `position(n, a, b)` may give another position near that one, at most b away.

    A quantile sketch with a guaranteed rank error brackets every position first.
    A second pass folds all values outside the bracket into one count on either
    side, so only the small share of distinct values inside it is ever ordered.
    """
    names = list(fractions)
    slack = 2.0 / accuracy
    if position:
        slack += max(b for _, b in fractions.values()) / max(frame.where(F.col(column).isNotNull()).count(), 1)
    edges = [e for a, b in fractions.values() for e in (max(0.0, a / b - slack), min(1.0, a / b + slack))]
    value = F.col(column).cast("double")
    sketch = frame.agg(F.percentile_approx(value, F.array(*[F.lit(e) for e in edges]), F.lit(accuracy))).scalar()
    marks = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda i: F.struct(i.alias("i"), F.element_at(F.col("_edges"), 2 * i + 1).alias("lo"), F.element_at(F.col("_edges"), 2 * i + 2).alias("hi")))
    rows = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), value.alias("d")).withColumn("_edges", sketch)
    spread = rows.select("v", "d", F.inline(marks))
    # exact ends: position 0 and the last one must not fall out of the bracket through ties
    side = F.when(F.col("d") < F.col("lo"), 0).when(F.col("d") > F.col("hi"), 2).otherwise(1)
    folded = spread.withColumn("side", side).groupBy("i", "side", F.when(F.col("side") == 1, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("i").orderBy("side", "v")
    placed = folded.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("i"))})
    wanted = F
    for i, (a, b) in enumerate(fractions.values()):
        wanted = wanted.when(F.col("i") == i, position(F.col("total"), a, b) if position else F.floor(F.col("total") * a / b))
    hit = placed.withColumn("wanted", wanted).where(
        (F.col("side") == 1) & (F.col("upto") - F.col("n") <= F.col("wanted")) & (F.col("upto") > F.col("wanted")))
    return hit.agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])


def champions(profiles: DataFrame, days_threshold: int = 45) -> DataFrame:
    """Champion customers with fragility; a missing recency counts as zero days."""
    middle = order_statistics(profiles, "total_revenue", {"median": (1, 2)}).scalar()
    days = F.coalesce("days_since_last_purchase", F.lit(0))
    score = 0.6 * F.least(days / 90.0, F.lit(1.0)) + 0.4 * F.col("churn_risk_score")
    chosen = profiles.where((F.col("behavior_type") == "regular") | ((F.col("total_revenue") >= middle) & (F.col("total_purchases") >= 3)))
    return chosen.select(
        "customer_id", F.col("total_revenue").cast("double").alias("revenue"), score.alias("fragility_score"),
        days.alias("days_since_purchase"), F.col("churn_risk_score").alias("churn_risk"),
        F.col("days_since_last_purchase").isNull().alias("never_purchased"),
        ((days >= days_threshold) | (score > 0.5)).alias("is_fragile"),
    )


def champion_summary(chosen: DataFrame) -> DataFrame:
    f = F.col("fragility_score")
    return chosen.agg(
        F.count("*").alias("champions"), F.count_if("is_fragile").alias("fragile"),
        F.coalesce(F.avg(F.col("is_fragile").cast("double")), F.lit(0.0)).alias("fragile_share"),
        money_sum(F.col("revenue")).alias("revenue"),
        F.coalesce(money_sum(F.when(F.col("is_fragile"), F.col("revenue"))), F.lit(0.0)).alias("revenue_at_risk"),
        F.count_if(f < 0.3).alias("low"), F.count_if((f >= 0.3) & (f < 0.6)).alias("medium"), F.count_if(f >= 0.6).alias("high"),
        F.count_if(F.col("days_since_purchase") > 30).alias("inactive_over_30_days"),
        F.count_if(F.col("churn_risk") > 0.5).alias("churn_over_half"),
        F.count_if("never_purchased").alias("never_purchased"),
    )


def lifetime_bucket(value: Column) -> Column:
    return (F.when(value < 50, "$0-50").when(value < 100, "$50-100").when(value < 250, "$100-250")
            .when(value < 500, "$250-500").otherwise("$500+"))


def new_customer_quality(profiles: DataFrame) -> DataFrame:
    """Purchase funnel, churn share and quality classes by value quartile."""
    cuts = order_statistics(profiles, "clv_estimate", {"q25": (1, 4), "q75": (3, 4)})
    cut = cuts.select(F.struct("q25", "q75")).scalar()
    v, n = F.col("clv_estimate"), F.col("total_purchases")
    tagged = profiles.withColumn("cut", cut)
    return tagged.agg(
        F.count("*").alias("customers"), F.count_if(n >= 2).alias("second_purchase"), F.count_if(n >= 3).alias("third_purchase"),
        F.avg((n >= 2).cast("double")).alias("conversion_to_second"), F.avg((n >= 3).cast("double")).alias("conversion_to_third"),
        F.avg((n == 1).cast("double")).alias("churn_rate"),
        F.count_if(v < F.col("cut.q25")).alias("low_quality"),
        F.count_if((v >= F.col("cut.q25")) & (v < F.col("cut.q75"))).alias("medium_quality"),
        F.count_if(v >= F.col("cut.q75")).alias("high_quality"),
        money_avg(v).alias("avg_lifetime_value"),
    )


def lifetime_distribution(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy(lifetime_bucket(F.col("clv_estimate")).alias("bucket")).agg(F.count("*").alias("customers"))


def churn_overview(profiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """At-risk totals and radar averages of all customers against the at-risk ones, in one pass."""
    risky = F.col("churn_risk_score") >= threshold
    days = F.coalesce("days_since_last_purchase", F.lit(0))

    def pair(name: str, value: Column, shape) -> list[Column]:
        return [shape(F.avg(value)).alias(f"{name}_all"), shape(F.avg(F.when(risky, value))).alias(f"{name}_at_risk")]

    return profiles.agg(
        F.count_if(risky).alias("at_risk"), F.avg(risky.cast("double")).alias("at_risk_share"),
        F.coalesce(money_sum(F.when(risky, F.col("clv_estimate"))), F.lit(0.0)).alias("value_at_risk"),
        F.count_if(F.col("days_since_last_purchase").isNull()).alias("never_purchased"),
        *pair("recency_risk", days, lambda a: F.when(a.isNotNull(), F.least(a / 60.0, F.lit(1.0)))),
        *pair("churn_score", F.col("churn_risk_score"), lambda a: a),
        *pair("frequency_drop", F.col("purchase_frequency_per_month"), lambda a: F.when(a.isNotNull(), 1 - F.least(a / 2.0, F.lit(1.0)))),
    )


def at_risk_customers(profiles: DataFrame, n: int = 50, threshold: float = 0.5) -> DataFrame:
    """The `n` customers most at risk (a top-k report)."""
    return profiles.where(F.col("churn_risk_score") >= threshold).select(
        "customer_id", F.col("churn_risk_score").alias("churn_risk"), F.col("clv_estimate").alias("clv"),
        F.coalesce("days_since_last_purchase", F.lit(0)).alias("days_since_purchase"), "total_purchases",
    ).orderBy(F.desc("churn_risk"), "customer_id").limit(n)


def category_opportunities(affinity: DataFrame, profiles: DataFrame) -> DataFrame:
    """Buyers, engaged non-buyers and estimated value per category name."""
    joined = affinity.join(profiles.select("customer_id", "clv_estimate"), "customer_id")
    buys, looks = F.col("purchase_count") > 0, (F.col("purchase_count") == 0) & (F.col("engagement_score") > 0.3)
    grouped = joined.groupBy("category").agg(
        F.count_if(buys).alias("buyers"), F.count_if(looks).alias("lookalikes"),
        F.coalesce(money_sum(F.when(buys, F.col("clv_estimate"))), F.lit(0.0)).alias("value"),
        F.coalesce(F.avg(F.when(looks, F.col("engagement_score"))), F.lit(0.0)).alias("avg_similarity"))
    average = ratio(F.col("value"), F.col("buyers"))
    return grouped.withColumn("buyer_avg_clv", average).withColumn(
        "opportunity_value", average * F.col("lookalikes") * F.lit(0.15)).drop("value")


def top_categories(opportunities: DataFrame, n: int = 10) -> DataFrame:
    return opportunities.orderBy(F.desc("opportunity_value"), "category").limit(n)


def data_period(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """Customers, events and the calendar days covered."""
    return profiles.agg(
        F.count("*").alias("customers"),
        F.date_format(F.min("first_seen"), "yyyy-MM-dd").alias("period_start"),
        F.date_format(F.max("last_seen"), "yyyy-MM-dd").alias("period_end"),
    ).withColumn("events", events.agg(F.count("*")).scalar())


def robustness_report(robustness: DataFrame) -> DataFrame:
    """Segments per tier, share of high robustness in percent, mean stability."""
    tier = F.col("robustness_tier")
    return robustness.agg(
        F.count("*").alias("segments"), F.count_if(tier == "HIGH").alias("high"), F.count_if(tier == "MEDIUM").alias("medium"),
        F.count_if(tier == "LOW").alias("low"), (F.avg((tier == "HIGH").cast("double")) * 100).alias("high_share"),
        F.avg("feature_stability").alias("avg_feature_stability"), F.avg("time_window_consistency").alias("avg_time_consistency"))


def critical_features(rows: DataFrame) -> DataFrame:
    """How often a feature is critical and how stable its segments are; `rows` has an array of them."""
    return rows.select("feature_stability", F.explode("critical_features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("segments"), F.avg("feature_stability").alias("avg_stability"))
