"""K-means over customer features, cluster statistics and segments built from labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.columns import money_avg, money_sum
from patronlens.functions.lineage import cut, few_parts
from patronlens.functions.picks import pick_first
from patronlens.operators.features import FEATURES, as_vectors, cluster_features, squared_distance, standardize
from patronlens.operators.multi_kmeans import Model, View, best_of, fit_many, rows_of, silhouettes
from patronlens.operators.traits import DAY_NAMES


class TooFewCustomers(ValueError):
    """Fewer customers than clusters."""


@dataclass(frozen=True)
class ClusterModel:
    """Centres of the best restart and its cost, the summed squared distance."""

    centres: tuple[tuple[float, ...], ...]
    cost: float

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Adds `cluster`, the number of the nearest centre; the smaller number wins a tie."""
        points = F.array(*[F.array(*[F.lit(v) for v in c]) for c in self.centres])
        apart = F.transform(points, lambda c: F.aggregate(F.zip_with(F.col("_x"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        found = vectors.withColumn("_x", vector_to_array("features")).withColumn("_apart", apart)
        return found.withColumn("cluster", (F.array_position("_apart", F.array_min("_apart")) - 1).cast("int")).drop("_x", "_apart")


def _rows(vectors: DataFrame, weight: str | None = None) -> DataFrame:
    return few_parts(cut(rows_of(vectors, "customer_id", vector_to_array("features"), [F.col(weight)] if weight else [])))


def _plain_view(rows: DataFrame, weighted: bool = False) -> View:
    width = len(rows.select("_x").first()[0])
    return View((0.0,) * width, (1.0,) * width, 0 if weighted else None)


def fit_kmeans(
    vectors: DataFrame, k: int, seed: int = 42, max_iter: int = 300, restarts: int = 10, weight: str | None = None,
) -> ClusterModel:
    """Best of several seeded fits by training cost; all restarts share every scan."""
    if vectors.limit(k).count() < k:
        raise TooFewCustomers(f"need at least {k} customers")
    rows = _rows(vectors, weight)
    view = _plain_view(rows, weight is not None)
    best = best_of(fit_many(rows, [Model(view, k, seed + i) for i in range(restarts)], max_iter))
    return ClusterModel(tuple(tuple(c) for c in best.centres.tolist() if c[0] == c[0]), best.cost)


def nearest_centroid(frame: DataFrame, names: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Cluster of the closest given centroid; the smaller index wins a tie."""
    options = F.array(*[
        F.struct(squared_distance(names, c).alias("distance"), F.lit(i).cast("bigint").alias("cluster")) for i, c in enumerate(centroids)
    ])
    return frame.withColumn("_near", F.array_min(options)).select("*", "_near.cluster", "_near.distance").drop("_near")


def centroid_update(assigned: DataFrame, names: Sequence[str]) -> DataFrame:
    """One refinement step: the mean of every cluster."""
    return assigned.groupBy("cluster").agg(*[F.avg(n).alias(n) for n in names])


def cluster_statistics(assigned: DataFrame, names: Sequence[str]) -> DataFrame:
    """Size, mean and population deviation of every feature, one row per cluster and feature."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])
    return assigned.select("cluster", F.inline(pairs)).groupBy("cluster", "feature").agg(
        F.count("*").alias("size"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("size"))


def size_summary(assigned: DataFrame) -> DataFrame:
    return cluster_sizes(assigned).agg(
        F.count("*").alias("clusters"), F.sum("size").alias("customers"), F.min("size").alias("min_size"),
        F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("std_size"))


def search_k(vectors: DataFrame, k_range: Sequence[int], seed: int = 42, restarts: int = 10) -> list[tuple[int, float, float]]:
    """(k, inertia, silhouette) per k; n - 1 caps k. All values of k and all restarts share every scan."""
    rows = _rows(vectors)
    n = rows.count()
    wanted = sorted({max(2, min(k, n - 1)) for k in k_range})
    if n < wanted[0]:
        raise TooFewCustomers(f"need at least {wanted[0]} customers")
    view = _plain_view(rows)
    fits = fit_many(rows, [Model(view, k, seed + i) for k in wanted for i in range(restarts)])
    best = [best_of(fits[i * restarts : (i + 1) * restarts]) for i in range(len(wanted))]
    return [(f.model.k, f.cost, s) for f, s in zip(best, silhouettes(rows, best), strict=True)]


def best_k(scores: Sequence[tuple[int, float, float]]) -> int:
    return max(scores, key=lambda s: (s[2], -s[0]))[0]


def members_of(assigned: DataFrame, prefix: str = "segment") -> DataFrame:
    return assigned.select("customer_id", F.concat(F.lit(f"{prefix}_"), F.col("cluster").cast("string")).alias("segment_id"))


# Labels of the segment description and their limits, from the highest band down.
VALUE_BANDS = ((500, "Premium high-value customers"), (200, "High-value customers"), (50, "Mid-value customers"))
LOWEST_VALUE = "Entry-level value customers"
SESSION_BANDS = ((20, "Highly engaged browsers"), (10, "Moderately engaged"))
LOWEST_SESSIONS = "Low engagement"
LEVEL_WORD = {1: "", 2: "subcategory ", 3: "specific "}


def _banded(value: Column, bands: Sequence[tuple[float, str]], lowest: str) -> Column:
    out = F
    for limit, label in bands:
        out = out.when(value >= limit, label)
    return out.otherwise(lowest)


def with_segment(profiles: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(profiles, "customer_id")


def segment_rollup(joined: DataFrame, value: str = "total_revenue") -> DataFrame:
    """Size, summed and average value, average order value per segment.

    `value` is total revenue unless predicted lifetime values were attached.
    """
    return joined.groupBy("segment_id").agg(
        F.count("*").alias("size"), money_sum(F.col(value)).alias("total_clv"), money_avg(F.col(value)).alias("avg_clv"),
        F.avg("avg_order_value").alias("avg_order_value"))


def attach_predictions(profiles: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Predicted lifetime value where there is one, else the revenue so far."""
    if predictions is None:
        return profiles.withColumn("segment_value", F.col("total_revenue").cast("double"))
    found = predictions.select("customer_id", "predicted_clv")
    return profiles.join(found, "customer_id", "left").withColumn(
        "segment_value", F.coalesce("predicted_clv", F.col("total_revenue").cast("double")))


def valued_by(profiles: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Profiles whose `total_revenue` is the predicted lifetime value where there is one."""
    if predictions is None:
        return profiles
    valued = attach_predictions(profiles.drop("predicted_clv"), predictions)
    return valued.withColumn("total_revenue", F.col("segment_value").cast(profiles.schema["total_revenue"].dataType)).select(*profiles.columns)


def segment_categories(members: DataFrame, affinity: DataFrame, top: int = 3) -> DataFrame:
    """Top categories per segment and level by number of customers (ties by name)."""
    counts = members.join(affinity.select("customer_id", "level", "category"), "customer_id").groupBy(
        "segment_id", "level", "category").agg(F.count("*").alias("customers"))
    order = Window.partitionBy("segment_id", "level").orderBy(F.desc("customers"), "category")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def distinctive_category(categories: DataFrame, sizes: DataFrame, concentration: float = 0.7) -> DataFrame:
    """Leading category at the first level that is not concentrated, or the deepest one."""
    leaders = categories.where(F.col("position") == 1).groupBy("segment_id").agg(
        *[F.max(F.when(F.col("level") == i, F.struct("category", "customers"))).alias(f"l{i}") for i in (1, 2, 3)])
    chosen = F
    for i in (1, 2, 3):
        share = F.col(f"l{i}.customers") / F.col("size")
        usable = F.col(f"l{i}").isNotNull()
        if i < 3:
            usable = usable & ~((share > concentration) & F.col(f"l{i + 1}").isNotNull())
        chosen = chosen.when(usable, F.struct(
            F.col(f"l{i}.category").alias("category"), F.lit(i).alias("level"), share.alias("share"), F.lit(LEVEL_WORD[i]).alias("word")))
    return leaders.join(sizes.select("segment_id", "size"), "segment_id").select("segment_id", chosen.alias("best"))


def _day_mode(column: str) -> Column:
    """Most frequent small integer of a group from fixed counters; the smaller value wins a tie."""
    top = 7 if column == "preferred_day_of_week" else 24
    counts = F.array(*[F.struct(F.count_if(F.col(column) == i).alias("n"), F.lit(-i).alias("v")) for i in range(top)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, -best["v"])


def segment_statistics(joined: DataFrame) -> DataFrame:
    """Averages and favourite times of every segment."""
    return joined.groupBy("segment_id").agg(
        F.count("*").alias("size"), money_avg(F.col("total_revenue")).alias("avg_revenue"), F.avg("avg_order_value").alias("avg_order_value"),
        F.avg("total_purchases").alias("avg_total_purchases"), F.avg("purchase_frequency_per_month").alias("avg_purchase_frequency"),
        F.avg("total_sessions").alias("avg_sessions"), F.avg("total_page_views").alias("avg_page_views"),
        F.avg("cart_abandonment_rate").alias("avg_cart_abandonment_rate"), F.avg("churn_risk_score").alias("avg_churn_score"),
        F.count_if(F.col("churn_risk_score") >= 0.7).alias("high_risk_count"),
        F.count_if(F.col("churn_risk_score") <= 0.3).alias("low_risk_count"),
        F.avg("mobile_session_ratio").alias("avg_mobile_ratio"),
        _day_mode("preferred_day_of_week").alias("preferred_day"), _day_mode("preferred_hour_of_day").alias("preferred_hour"))


def time_distribution(joined: DataFrame, column: str) -> DataFrame:
    return joined.where(F.col(column).isNotNull()).groupBy("segment_id", F.col(column).cast("bigint").alias("slot")).agg(
        F.count("*").alias("customers"))


def segment_traits(statistics: DataFrame, best: DataFrame) -> DataFrame:
    """Ordered defining traits per segment, as labels from thresholds."""
    c = F.col
    pct = c("best.share") * 100
    shown = F.concat(F.bround(pct, 0).cast("bigint").cast("string"), F.lit("%)"))
    category = (
        F.when(pct >= 30, F.concat(F.lit("Strong "), c("best.word"), c("best.category"), F.lit(" affinity ("), shown))
        .when(pct >= 15, F.concat(F.lit("Moderate "), c("best.word"), c("best.category"), F.lit(" interest ("), shown)))
    cart = F.when(c("avg_cart_abandonment_rate") >= 0.7, "High cart abandonment risk").when(
        c("avg_cart_abandonment_rate") <= 0.2, "Strong purchase completion")
    churn = F.when(c("avg_churn_score") >= 0.7, "At-risk of churning").when(c("avg_churn_score") <= 0.3, "Loyal customer base")
    device = F.when(c("avg_mobile_ratio") >= 0.7, "Mobile-first shoppers").when(
        c("avg_mobile_ratio") <= 0.3, "Desktop-preferred shoppers").otherwise("Multi-device shoppers")
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    day = F.when(c("preferred_day") >= 5, "Weekend shoppers").when(
        c("preferred_day").isNotNull(), F.concat(F.element_at(names, F.coalesce(c("preferred_day"), F.lit(0)) + 1), F.lit(" peak activity")))
    h = c("preferred_hour")
    hour = (F.when(h.between(6, 11), "Morning shoppers").when(h.between(12, 16), "Afternoon shoppers")
            .when(h.between(17, 20), "Evening shoppers").when(h.isNotNull(), "Late-night shoppers"))
    labels = F.array_compact(F.array(
        category, _banded(c("avg_revenue"), VALUE_BANDS, LOWEST_VALUE), _banded(c("avg_sessions"), SESSION_BANDS, LOWEST_SESSIONS),
        cart, churn, device, day, hour))
    return statistics.join(best, "segment_id", "left").select("segment_id", labels.alias("defining_traits"))


def segment_name(traits: Column, segment_id: Column) -> Column:
    """First of the two leading traits that does not speak of customers."""
    plain = F.filter(F.slice(traits, 1, 2), lambda t: ~F.lower(t).contains("customer"))
    return F.coalesce(F.try_element_at(plain, F.lit(1)), F.concat(F.lit("Cluster "), F.regexp_extract(segment_id, r"_(.*)$", 1)))


def segment_description(traits: Column, size: Column) -> Column:
    return F.concat(F.lit("Auto-generated cluster with "), size.cast("string"), F.lit(" customers. "), F.array_join(F.slice(traits, 1, 3), ", "))


def describe_segments(members: DataFrame, profiles: DataFrame, affinity: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Segments with size, value, name, description and defining traits."""
    joined = with_segment(attach_predictions(profiles, predictions), members)
    statistics = segment_statistics(joined)
    best = distinctive_category(segment_categories(members, affinity), statistics)
    return segment_rollup(joined, "segment_value").join(segment_traits(statistics, best), "segment_id").withColumns({
        "name": segment_name(F.col("defining_traits"), F.col("segment_id")),
        "description": segment_description(F.col("defining_traits"), F.col("size")),
    })


@dataclass(frozen=True)
class Segmentation:
    members: DataFrame
    segments: DataFrame
    statistics: DataFrame
    model: ClusterModel


def create_segments(
    profiles: DataFrame, affinity: DataFrame, k: int | None = None, k_range: Sequence[int] = range(3, 11), seed: int = 42,
    restarts: int = 10, names: Sequence[str] = FEATURES, predictions: DataFrame | None = None,
) -> Segmentation:
    """Standardise, cluster (searching k when none is given), label and describe."""
    profiles = cut(profiles)
    scaled = standardize(cluster_features(profiles, names), names)
    vectors = cut(as_vectors(scaled, names))
    if k is None:
        k = best_k(search_k(vectors, k_range, seed))
    model = fit_kmeans(vectors, k, seed, restarts=restarts)
    assigned = model.transform(vectors)
    members = cut(members_of(assigned))
    return Segmentation(members, describe_segments(members, profiles, affinity, predictions), cluster_statistics(assigned, names), model)
