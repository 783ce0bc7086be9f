"""Clustering features and their standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = {
    "value": ("total_revenue", "avg_order_value", "clv_estimate", "total_purchases", "purchase_frequency", "churn_risk"),
    "engagement": ("total_sessions", "total_page_views", "total_items_viewed", "cart_abandonment_rate"),
    "temporal": ("preferred_day", "preferred_hour"),
    "channel": ("mobile_ratio",),
}
_SOURCE = {
    "purchase_frequency": "purchase_frequency_per_month", "churn_risk": "churn_risk_score",
    "preferred_day": "preferred_day_of_week", "preferred_hour": "preferred_hour_of_day", "mobile_ratio": "mobile_session_ratio",
}
FEATURES = tuple(name for group in GROUPS.values() for name in group)


def feature_names(groups: Sequence[str] = tuple(GROUPS), without: Sequence[str] = ()) -> tuple[str, ...]:
    return tuple(n for g in groups for n in GROUPS[g] if n not in without)


def cluster_features(profiles: DataFrame, names: Sequence[str] = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns as doubles; a missing favourite day or hour is -1."""
    columns = []
    for name in names:
        value = F.col(_SOURCE.get(name, name)).cast("double")
        columns.append((F.coalesce(value, F.lit(-1.0)) if name.startswith("preferred") else value).alias(name))
    return profiles.select("customer_id", *keep, *columns)


def fit_scaler(frame: DataFrame, names: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row with the mean and population deviation of every column."""
    if weight is None:
        return frame.agg(*[F.avg(n).alias(f"{n}__mean") for n in names], *[F.stddev_pop(n).alias(f"{n}__std") for n in names])
    total = F.sum(weight)
    centre = frame.agg(*[(F.sum(F.col(n) * F.col(weight)) / total).alias(f"{n}__mean") for n in names])
    with_centre = frame.withColumn("_m", centre.select(F.struct("*")).scalar())
    spread = [
        F.sqrt(F.sum(F.col(weight) * F.pow(F.col(n) - F.col(f"_m.{n}__mean"), 2)) / total).alias(f"{n}__std") for n in names
    ]
    return with_centre.agg(*[F.first(f"_m.{n}__mean").alias(f"{n}__mean") for n in names], *spread)


def apply_scaler(frame: DataFrame, names: Sequence[str], scaler: DataFrame) -> DataFrame:
    """(x - mean) / std with the one-row scaler as a scalar subquery; zero deviation scales by 1."""
    with_scaler = frame.withColumn("_s", scaler.select(F.struct("*")).scalar())
    scaled = {
        n: (F.col(n) - F.col(f"_s.{n}__mean")) / F.when(F.col(f"_s.{n}__std") == 0, 1.0).otherwise(F.col(f"_s.{n}__std"))
        for n in names
    }
    return with_scaler.withColumns(scaled).drop("_s")


def standardize(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    return apply_scaler(frame, names, fit_scaler(frame, names))


def as_vectors(frame: DataFrame, names: Sequence[str], output: str = "features") -> DataFrame:
    """ML vector column; the names stay in its attribute metadata."""
    return VectorAssembler(inputCols=list(names), outputCol=output).transform(frame)


def squared_distance(names: Sequence[str], point: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for name, value in zip(names, point, strict=True):
        delta = F.col(name) - F.lit(float(value))
        total = total + delta * delta
    return total
