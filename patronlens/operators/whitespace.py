"""Cross-sell whitespace: engaged non-buyers that look like the buyers of a category.

Categories are keyed by (level, category). All categories go through one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.columns import money_avg, ratio
from patronlens.functions.joins import join_few
from patronlens.functions.lineage import cut
from patronlens.operators.neighbours import nearest, nearest_lists, unit

# Features by which customers are compared.
CATEGORY_FEATURES = (
    "category_view_count", "category_engagement_score", "total_sessions", "total_page_views", "cart_abandonment_rate", "mobile_session_ratio",
)
GENERAL_FEATURES = (
    "total_sessions", "total_page_views", "total_items_viewed", "total_cart_additions", "cart_abandonment_rate", "mobile_session_ratio",
    "days_active", "session_frequency",
)
KEYS = ["level", "category"]
MIN_BUYERS, NEIGHBOURS, THRESHOLD, TOP_CANDIDATES = 5, 5, 0.5, 100
_CARRIED = ("total_revenue", "total_purchases", "total_items_viewed", "total_cart_additions")


def engagement_features(profiles: DataFrame) -> DataFrame:
    """General engagement features; a day of activity counts even when first and last are the same."""
    days = F.col("tenure_days") + 1
    return profiles.select(
        "customer_id", *[F.col(n).cast("double").alias(n) for n in GENERAL_FEATURES[:6]],
        days.cast("double").alias("days_active"), ratio(F.col("total_sessions"), F.greatest(days, F.lit(1))).alias("session_frequency"))


def category_engagement(affinity: DataFrame, profiles: DataFrame) -> DataFrame:
    """Category features per customer and category, with the role of the customer in it."""
    joined = affinity.select("customer_id", *KEYS, "view_count", "purchase_count", "engagement_score").join(
        profiles.select("customer_id", "total_sessions", "total_page_views", "cart_abandonment_rate", "mobile_session_ratio", *_CARRIED), "customer_id")
    role = F.when(F.col("purchase_count") > 0, "buyer").when(F.col("view_count") >= 1, "candidate")
    return joined.select(
        "customer_id", *KEYS, role.alias("role"), F.col("view_count").cast("double").alias("category_view_count"),
        F.col("engagement_score").alias("category_engagement_score"),
        *[F.col(n).cast("double").alias(n) for n in CATEGORY_FEATURES[2:]],
        *_CARRIED).where(F.col("role").isNotNull())


def _buyer_statistics(rows: DataFrame, group: Sequence[str], names: Sequence[str], min_buyers: int) -> DataFrame:
    buyers = rows.where(F.col("role") == "buyer")
    return buyers.groupBy(*group).agg(
        F.count("*").alias("n_buyers"), money_avg(F.col("total_revenue")).alias("buyer_avg_clv"),
        F.avg("total_purchases").alias("buyer_avg_purchases"),
        *[F.avg(n).alias(f"{n}__mean") for n in names], *[F.stddev_pop(n).alias(f"{n}__std") for n in names],
    ).where(F.col("n_buyers") >= min_buyers)


def _searched(search: Callable[..., DataFrame], rows: DataFrame, group: Sequence[str], names: Sequence[str], min_buyers: int, k: int):
    statistics = _buyer_statistics(rows, group, names, min_buyers)
    scaled = join_few(rows, statistics, group).select(
        F.col("customer_id").alias("id"), *group, "role",
        *[((F.col(n) - F.col(f"{n}__mean")) / F.when(F.col(f"{n}__std") == 0, 1.0).otherwise(F.col(f"{n}__std"))).alias(n) for n in names])
    vectors = cut(unit(scaled, names))
    found = search(vectors.where(F.col("role") == "buyer"), vectors.where(F.col("role") == "candidate"), group, names, k)
    return statistics, found


def similarity(rows: DataFrame, group: Sequence[str], names: Sequence[str], min_buyers: int = MIN_BUYERS, k: int = NEIGHBOURS):
    """(statistics per group, neighbours of every candidate), scaled by the buyers of the group."""
    return _searched(nearest, rows, group, names, min_buyers, k)


def alike(rows: DataFrame, group: Sequence[str], names: Sequence[str], threshold: float = THRESHOLD, min_buyers: int = MIN_BUYERS, k: int = NEIGHBOURS):
    """(statistics per group, lookalikes): as `lookalikes` of `similarity`, judged on the list of each vector before its owners are joined."""
    statistics, lists = _searched(nearest_lists, rows, group, names, min_buyers, k)
    mean = F.aggregate(F.col("found.similarity"), F.lit(0.0), lambda held, v: held + v) / F.size("found")
    return statistics, lists.where(mean >= threshold).select(
        *group, F.col("id").alias("customer_id"), mean.alias("similarity"), F.col("found.neighbour_id").alias("nearest_buyers"))


def lookalikes(neighbours: DataFrame, group: Sequence[str] = KEYS, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates whose mean positive similarity reaches the threshold, with their nearest buyers."""
    return neighbours.groupBy(*group, "id").agg(
        F.avg("similarity").alias("similarity"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "neighbour_id"))), lambda n: n["neighbour_id"]).alias("nearest_buyers"),
    ).where(F.col("similarity") >= threshold).withColumnRenamed("id", "customer_id")


def category_whitespace(rows: DataFrame, statistics: DataFrame, found: DataFrame, group: Sequence[str] = KEYS) -> DataFrame:
    """Buyers, candidates, lookalikes and opportunity per category."""
    candidates = rows.where(F.col("role") == "candidate").groupBy(*group).agg(F.count("*").alias("n_candidates"))
    alike = found.groupBy(*group).agg(F.count("*").alias("n_lookalikes"), F.avg("similarity").alias("avg_similarity"))
    out = statistics.select(*group, "n_buyers", "buyer_avg_clv", "buyer_avg_purchases").join(candidates, list(group), "left").join(alike, list(group), "left")
    out = out.withColumns({
        "n_candidates": F.coalesce("n_candidates", F.lit(0)), "n_lookalikes": F.coalesce("n_lookalikes", F.lit(0)),
        "avg_similarity": F.coalesce("avg_similarity", F.lit(0.0)),
    })
    return out.withColumn("opportunity_value", F.col("buyer_avg_clv") * F.col("n_lookalikes"))


def ranked_candidates(found: DataFrame, top: int = TOP_CANDIDATES, group: Sequence[str] = KEYS) -> DataFrame:
    """The most similar candidates of every category (a top-k report)."""
    order = Window.partitionBy(*group).orderBy(F.desc("similarity"), "customer_id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def top_opportunities(found: DataFrame, per_category: int = 10, n: int = 100) -> DataFrame:
    return ranked_candidates(found, per_category).orderBy(F.desc("similarity"), *KEYS, "customer_id").limit(n)


def top_whitespace(categories: DataFrame, n: int = 5) -> DataFrame:
    return categories.where(F.col("n_lookalikes") > 0).orderBy(F.desc("opportunity_value"), *KEYS).limit(n)


def role_averages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Averages of buyers against lookalikes per category."""
    alike = rows.where(F.col("role") == "candidate").join(found.select(*KEYS, "customer_id"), [*KEYS, "customer_id"], "left_semi")
    both = rows.where(F.col("role") == "buyer").unionByName(alike.withColumn("role", F.lit("lookalike")))
    return both.groupBy(*KEYS, "role").agg(
        F.count("*").alias("customers"), F.avg("total_sessions").alias("avg_sessions"), F.avg("total_page_views").alias("avg_page_views"),
        F.avg("total_items_viewed").alias("avg_items_viewed"), F.avg("total_cart_additions").alias("avg_cart_additions"),
        money_avg(F.col("total_revenue")).alias("avg_clv"), F.avg("total_purchases").alias("avg_purchases"),
        F.avg("category_view_count").alias("avg_category_views"))


def whitespace_summary(categories: DataFrame, profiles: DataFrame) -> DataFrame:
    live = categories.where(F.col("n_lookalikes") > 0)
    return live.agg(
        F.count("*").alias("categories"), F.coalesce(F.sum("n_lookalikes"), F.lit(0)).alias("opportunities"),
        F.coalesce(F.sum("opportunity_value"), F.lit(0.0)).alias("opportunity_value"), F.avg("avg_similarity").alias("avg_similarity"),
    ).withColumn("customers", profiles.agg(F.count("*")).scalar())


def cross_category(affinity: DataFrame, profiles: DataFrame, source: tuple[int, str], target: tuple[int, str], threshold: float = THRESHOLD):
    """Source buyers that viewed the target without buying it, compared with target buyers.

    Returns (summary, lookalikes). Membership is decided by semi and anti joins.
    """
    def of(pair: tuple[int, str], condition: Column) -> DataFrame:
        return affinity.where((F.col("level") == pair[0]) & (F.col("category") == pair[1]) & condition).select("customer_id")

    buys, views = F.col("purchase_count") > 0, F.col("view_count") > 0
    buyers = of(target, buys)
    people = engagement_features(profiles).join(profiles.select("customer_id", "total_revenue", "total_purchases"), "customer_id")
    seeds = people.join(buyers, "customer_id", "left_semi").withColumn("role", F.lit("buyer"))
    hopefuls = (
        people.join(of(source, buys), "customer_id", "left_semi").join(of(target, views), "customer_id", "left_semi")
        .join(buyers, "customer_id", "left_anti").withColumn("role", F.lit("candidate")))
    label = F.lit(f"{source[1]} -> {target[1]}")
    rows = cut(seeds.unionByName(hopefuls).withColumn("pair", label))
    statistics, found = alike(rows, ["pair"], GENERAL_FEATURES, threshold)
    return category_whitespace(rows, statistics, found, ["pair"]), found


def segment_whitespace(members: DataFrame, found: DataFrame, categories: DataFrame) -> DataFrame:
    """Lookalikes of every segment per category; over segments of all customers they add up to the category's."""
    joined = members.join(found.select("customer_id", *KEYS, "similarity"), "customer_id")
    grouped = joined.groupBy("segment_id", *KEYS).agg(F.count("*").alias("n_lookalikes"), F.avg("similarity").alias("avg_similarity"))
    return grouped.join(categories.select(*KEYS, "buyer_avg_clv"), KEYS).withColumn(
        "opportunity_value", F.col("buyer_avg_clv") * F.col("n_lookalikes"))


def segment_opportunity(per_category: DataFrame) -> DataFrame:
    return per_category.groupBy("segment_id").agg(
        F.sum("opportunity_value").alias("whitespace_value"), F.sum("n_lookalikes").alias("n_lookalikes"),
        F.min_by("category", F.struct((-F.col("opportunity_value")).alias("v"), "level", "category")).alias("top_category"))
