"""Customer lifetime value: features, training, evaluation, prediction and contributions."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronlens.functions.columns import ratio
from patronlens.functions.lineage import cut, few_parts, shared_folder
from patronlens.operators.features import as_vectors
from patronlens.operators.multi_kmeans import folded, moments, rows_of
from patronlens.operators.reports import order_statistics

# Features of each group.
FEATURES = {
    "rfm": ("days_since_last_purchase", "total_purchases", "purchase_frequency_per_month", "total_revenue", "avg_order_value",
            "total_refunds", "refund_rate", "churn_risk_score"),
    "engagement": ("total_sessions", "total_page_views", "total_items_viewed", "total_cart_additions", "cart_abandonment_rate"),
    "intervals": ("interval_mean", "interval_std", "interval_cv", "interval_min", "interval_max", "regularity_index"),
    "temporal": ("tenure_days", "preferred_dow", "preferred_hour", "prefers_weekend"),
    "efficiency": ("revenue_per_session", "pages_per_session", "items_per_session", "cart_to_purchase_rate", "purchase_per_session",
                   "activity_density"),
    "category": ("category_count", "top_category_score", "top_category_purchases", "category_concentration"),
    "behavior": ("is_regular", "is_irregular", "is_long_cycle", "is_one_time", "is_new", "mobile_session_ratio", "is_mobile_primary"),
    "seasonality": ("last_month_sin", "last_month_cos", "last_doy_sin", "last_doy_cos", "pref_dow_sin", "pref_dow_cos", "pref_hour_sin",
                    "pref_hour_cos"),
}


#: Features that give a target away: the target itself and what is computed from it.
GIVEN_AWAY = {"total_revenue": ("total_revenue", "avg_order_value", "revenue_per_session")}


def names_of(groups: Sequence[str] = tuple(FEATURES), without: Sequence[str] = ()) -> tuple[str, ...]:
    return tuple(n for g in groups for n in FEATURES[g] if n not in without)


def top_level_categories(affinity: DataFrame) -> DataFrame:
    """Leading level-one category per customer: its score, purchases and share of the score."""
    order = F.struct((-F.col("engagement_score")).alias("s"), "first_engaged", "category")
    return affinity.where(F.col("level") == 1).groupBy("customer_id").agg(
        F.max("engagement_score").alias("top_category_score"),
        F.min_by("purchase_count", order).cast("double").alias("top_category_purchases"),
        (F.max("engagement_score") / F.sum("engagement_score")).alias("category_concentration"))


def _cycle(value: Column, period: float, wave) -> Column:
    return F.coalesce(wave(F.lit(2 * math.pi) * value / F.lit(float(period))), F.lit(0.0))


def build_features(profiles: DataFrame, affinity: DataFrame | None, names: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns as doubles, one row per customer; only the asked ones are computed.

    Profiles that hold the columns of the leading category need no affinity.
    """
    names = names_of() if names is None else names
    c = F.col
    sessions, tenure = c("total_sessions"), c("tenure_days")
    missing = lambda n: F.coalesce(c(n).cast("double"), F.lit(-1.0))
    dow, hour, last = c("preferred_day_of_week"), c("preferred_hour_of_day"), c("last_seen")
    made: dict[str, Column] = {
        "days_since_last_purchase": missing("days_since_last_purchase"),
        **{n: missing(n) for n in FEATURES["intervals"]},
        "preferred_dow": missing("preferred_day_of_week"), "preferred_hour": missing("preferred_hour_of_day"),
        "prefers_weekend": F.coalesce(dow.isin(5, 6), F.lit(False)).cast("double"),
        "revenue_per_session": ratio(c("total_revenue"), sessions), "pages_per_session": ratio(c("total_page_views"), sessions),
        "items_per_session": ratio(c("total_items_viewed"), sessions),
        "cart_to_purchase_rate": ratio(c("total_purchases"), c("total_cart_additions")),
        "purchase_per_session": ratio(c("total_purchases"), sessions),
        "activity_density": F.when(tenure > 0, sessions / tenure).otherwise(sessions.cast("double")),
        **{n: F.coalesce(c(n), F.lit(0.0)) for n in ("top_category_score", "top_category_purchases", "category_concentration")},
        **{f"is_{b}": (c("behavior_type") == b).cast("double") for b in ("regular", "irregular", "long_cycle", "one_time", "new")},
        "is_mobile_primary": (c("mobile_session_ratio") > 0.5).cast("double"),
    }
    for name, value, period in (("last_month", F.month(last), 12), ("last_doy", F.dayofyear(last), 365), ("pref_dow", dow, 7), ("pref_hour", hour, 24)):
        made[f"{name}_sin"], made[f"{name}_cos"] = _cycle(value, period, F.sin), _cycle(value, period, F.cos)
    base = profiles
    if any(n in names and n not in profiles.columns for n in FEATURES["category"][1:]):
        base = profiles.join(top_level_categories(affinity), "customer_id", "left")
    kept = [c(n).alias(f"_{n}") if n in names else c(n) for n in keep]
    return base.select("customer_id", *kept, *[made.get(n, c(n)).cast("double").alias(n) for n in names])


@dataclass(frozen=True)
class TrainingConfig:
    """The target and what derives from it are left out of the features unless it lies in the future of them."""

    model: str = "gradient_boosting"
    target: str = "total_revenue"
    splits: int = 5
    seed: int = 42
    params: dict = field(default_factory=dict)
    groups: tuple[str, ...] = tuple(FEATURES)
    keep_target_as_feature: bool = False

    @property
    def names(self) -> tuple[str, ...]:
        return names_of(self.groups, () if self.keep_target_as_feature else GIVEN_AWAY.get(self.target, (self.target,)))


def estimator(config: TrainingConfig, n_rows: int) -> Estimator:
    """Regressor by name with its default parameters, overridden by `params`."""
    shared = {"featuresCol": "features", "labelCol": "target", "predictionCol": "prediction"}
    if config.model == "gradient_boosting":
        return GBTRegressor(**{**shared, "maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 5, "seed": config.seed, **config.params})
    if config.model == "random_forest":
        return RandomForestRegressor(**{**shared, "numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 5, "seed": config.seed, **config.params})
    if config.model == "ridge":
        params = dict(config.params)
        alpha = params.pop("alpha", 1.0)
        return LinearRegression(**{**shared, "elasticNetParam": 0.0, "regParam": alpha / max(n_rows, 1), "standardization": False, **params})
    raise ValueError(f"unknown model {config.model!r}")


def training_table(profiles: DataFrame, affinity: DataFrame | None, config: TrainingConfig) -> DataFrame:
    """Features, target and time of every customer as one materialised vector table.

    In a tree fit each part sends dense sums for all open nodes of a level, so its parts are few.
    """
    rows = build_features(profiles.withColumn("target", F.col(config.target).cast("double")), affinity, config.names, keep=("target", "last_seen"))
    return few_parts(cut(as_vectors(rows, config.names).select("customer_id", "target", "last_seen", "features")))


def time_folds(table: DataFrame, splits: int = 5) -> DataFrame:
    """Number of the test fold of every row in time order; fold 0 is only trained on.

    Fold borders are exact order statistics of (last_seen), found by counting equal
    instants, not by sorting everything in one partition. Rows of the same instant
    as a border stay together in the later fold.
    """
    stamped = table.withColumn("_t", F.unix_micros("last_seen"))
    n = splits + 1
    # the first fold takes the remainder, as in an expanding-window split with equal test folds
    marks = order_statistics(stamped, "_t", {f"b{i}": (i, n) for i in range(1, n)}, position=lambda rows, i, parts: rows - (parts - i) * F.floor(rows / parts))
    borders = marks.first()  # `splits` numbers
    fold = F.lit(0)
    for i in range(1, n):
        fold = fold + (F.col("_t") >= F.lit(borders[f"b{i}"]).cast("bigint")).cast("int")
    return stamped.withColumn("fold", fold).drop("_t")


def metrics(predicted: DataFrame, actual: str = "target", guess: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and MAPE (over non-zero targets, in percent) in one aggregation, for each group if there is one."""
    y, p = F.col(actual), F.col(guess)
    return predicted.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
        F.when(F.var_pop(y) == 0, F.lit(0.0)).otherwise(1 - F.avg(F.pow(y - p, 2)) / F.var_pop(y)).alias("r2"),
        F.coalesce(F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100, F.lit(0.0)).alias("mape"))


def ridge_folds(folds: DataFrame, splits: int, alpha: float = 1.0) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of the ridge fit to all rows before each test fold, from one scan.

    Every fold is folded to its Gram matrix and moments about the overall means; the matrices of
    the folds before a test fold add up, and each fit is a small solve on the driver. The intercept
    is not penalised.
    """
    rows = rows_of(folds, "customer_id", vector_to_array("features"), [F.col("fold"), F.col("target")])
    width = len(rows.select("_x").first()[0])
    [(_, centre, _)] = moments(rows, width, [None])
    size = width + 2  # ones, features, target

    def gram(blocks):
        total = np.zeros((splits + 1, size, size))
        for _, x, w in blocks:
            full = np.column_stack([np.ones(len(x)), x - centre, w[:, 1]])
            for fold in np.unique(w[:, 0]).astype(int):
                own = full[w[:, 0] == fold]
                total[fold] += own.T @ own
        return [(fold, j, *row) for fold, matrix in enumerate(total) for j, row in enumerate(matrix)]

    found = folded(rows, gram, size)
    matrices = np.array([[found.get((f, j), [0.0] * size) for j in range(size)] for f in range(splits + 1)])
    out = []
    for test in range(1, splits + 1):
        m = matrices[:test].sum(0)
        n, sums = max(m[0, 0], 1.0), m[0, 1:]
        inner = m[1:, 1:] - np.outer(sums, sums) / n
        beta = np.linalg.solve(inner[:-1, :-1] + alpha * np.eye(width), inner[:-1, -1])
        out.append((beta, float(sums[-1] / n - beta @ (sums[:-1] / n + centre))))
    return out


def _fold_metrics(predicted: DataFrame) -> DataFrame:
    """The metrics of every fold in one aggregation."""
    return metrics(predicted, by=("fold",)).withColumn("fold", F.col("fold").cast("bigint"))


def cross_validate(table: DataFrame, config: TrainingConfig) -> DataFrame:
    """Metrics per fold of an expanding-window split; each model sees only earlier rows.

    Ridge fits of all folds come from one scan, and one more scores them, both of the given table. Trees have no such
    sums; their fits start together from one materialised table and share the cluster.
    """
    folds = time_folds(table, config.splits)
    if config.model == "ridge" and not set(config.params) - {"alpha"}:
        fits = ridge_folds(folds, config.splits, config.params.get("alpha", 1.0))
        betas = F.array(*[F.array(*[F.lit(float(v)) for v in (b, *beta)]) for beta, b in fits])
        x = F.concat(F.array(F.lit(1.0)), vector_to_array("features"))
        guess = F.aggregate(F.zip_with(x, betas[F.col("fold") - 1], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return _fold_metrics(folds.where("fold > 0").select("fold", "target", guess.alias("prediction")))

    folds = cut(folds)

    def score(i: int) -> DataFrame:
        past = folds.where(F.col("fold") < i)
        model = estimator(config, past.count()).fit(past)
        return model.transform(folds.where(F.col("fold") == i)).select("fold", "target", "prediction")

    with ThreadPool(min(config.splits, 3)) as pool:
        parts = pool.map(inheritable_thread_target(score), range(1, config.splits + 1))
    return _fold_metrics(reduce(DataFrame.unionByName, parts))


def time_holdout(table: DataFrame, fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Earlier rows to train on and the most recent ones to test on."""
    parts = 1000
    at = min(max(round(parts * (1 - fraction)), 0), parts)
    stamped = table.withColumn("_t", F.unix_micros("last_seen"))
    border = order_statistics(stamped, "_t", {"b": (at, parts)}, position=lambda rows, a, b: F.floor(rows * F.lit(1.0 - fraction))).scalar()
    tagged = cut(stamped.withColumn("_old", F.col("_t") < border).drop("_t"))
    return tagged.where("_old").drop("_old"), tagged.where(~F.col("_old")).drop("_old")


def importances(model: Model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances, or normalised absolute coefficients; they sum to one."""
    if isinstance(model, LinearRegressionModel):
        raw = [abs(v) for v in model.coefficients.toArray().tolist()]
    else:
        raw = model.featureImportances.toArray().tolist()
    total = sum(raw) or 1.0
    return [(n, v / total) for n, v in zip(names, raw, strict=True)]


@dataclass(frozen=True)
class Predictor:
    model: Model
    names: tuple[str, ...]
    weights: tuple[tuple[str, float], ...]
    kind: str
    version: str = "v1"

    def predict(self, profiles: DataFrame, affinity: DataFrame | None, top: int = 5) -> DataFrame:
        """Non-negative prediction in cents, confidence and the features that weigh most."""
        rows = as_vectors(build_features(profiles, affinity, self.names), self.names)
        forest = isinstance(self.model, RandomForestRegressionModel)
        scored = self.model.transform(rows, {self.model.leafCol: "_leaves"}) if forest else self.model.transform(rows)
        found = scored.select(
            "customer_id", F.round(F.greatest(F.lit(0.0), F.col("prediction")), 2).alias("predicted_clv"), self.top_features(top).alias("top_features"),
            *([F.col("_leaves")] if forest else []))
        sure = self._confidence(found) if forest else found.withColumn("confidence", F.lit(0.8))
        return sure.select("customer_id", "predicted_clv", F.round("confidence", 3).alias("confidence"), F.lit(self.version).alias("model_version"), "top_features")

    def _confidence(self, scored: DataFrame) -> DataFrame:
        """One minus the variation across the trees of a forest.

        Each row's leaves meet the table of leaf predictions and fold to moments again. That
        table has at most trees x 2**depth rows, whatever the data, so it is broadcast.
        """
        leaves = scored.select("*", F.posexplode(vector_to_array("_leaves")).alias("tree", "_leaf")).withColumn("leaf", F.col("_leaf").cast("int"))
        met = leaves.join(F.broadcast(leaf_table(self.model)), ["tree", "leaf"])
        moments = met.groupBy("customer_id").agg(
            F.first("predicted_clv").alias("predicted_clv"), F.first("top_features").alias("top_features"), F.avg("guess").alias("mean"), F.stddev_pop("guess").alias("spread"))
        certain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("spread") / F.abs("mean")))
        return moments.withColumn("confidence", F.when(F.col("mean") == 0, 0.5).otherwise(certain))

    def top_features(self, n: int = 5) -> Column:
        """Names with the largest absolute value times importance."""
        items = F.array(*[F.struct((-F.abs(F.col(name)) * F.lit(w)).alias("score"), F.lit(name).alias("name")) for name, w in self.weights])
        return F.transform(F.slice(F.array_sort(items), 1, n), lambda i: i["name"])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        side = {"names": list(self.names), "weights": [list(w) for w in self.weights], "kind": self.kind, "version": self.version}
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @staticmethod
    def load(path: str) -> Predictor:
        side = json.loads(SparkSession.active().read.text(f"{path}/config").first()["value"])
        loader = {"gradient_boosting": GBTRegressionModel, "random_forest": RandomForestRegressionModel, "ridge": LinearRegressionModel}[side["kind"]]
        return Predictor(loader.load(f"{path}/model"), tuple(side["names"]), tuple((n, w) for n, w in side["weights"]), side["kind"], side["version"])


def leaf_table(model: RandomForestRegressionModel) -> DataFrame:
    """(tree, leaf, guess): the prediction of every leaf, from the node data that Spark ML writes of a model.

    Nodes are numbered from the root down and from left to right, and so are the leaves.
    """
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/forest"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*").where("leftChild < 0")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    return nodes.select("tree", place.alias("leaf"), F.col("prediction").alias("guess"))


def train(profiles: DataFrame, affinity: DataFrame | None, config: TrainingConfig = TrainingConfig(), version: str = "v1") -> tuple[Predictor, DataFrame]:
    """Final model over all rows, with its metrics on them."""
    table = training_table(profiles, affinity, config)
    model = estimator(config, table.count()).fit(table)
    weights = tuple(importances(model, config.names))
    return Predictor(model, config.names, weights, config.model, version), metrics(model.transform(table))


def train_with_holdout(profiles: DataFrame, affinity: DataFrame | None, config: TrainingConfig = TrainingConfig(), fraction: float = 0.2):
    """Model of the earlier rows and its metrics on the most recent ones."""
    past, recent = time_holdout(training_table(profiles, affinity, config), fraction)
    model = estimator(config, past.count()).fit(past)
    return Predictor(model, config.names, tuple(importances(model, config.names)), config.model), metrics(model.transform(recent))


def linear_contributions(features: DataFrame, names: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """Exact contributions of a linear model: coefficient times distance from the mean."""
    means = features.agg(*[F.avg(n).alias(n) for n in names]).select(F.struct("*")).scalar()
    rows = features.withColumn("_m", means)
    items = F.array(*[
        F.struct(F.lit(n).alias("feature"), (F.lit(float(b)) * (F.col(n) - F.col(f"_m.{n}"))).alias("contribution"))
        for n, b in zip(names, coefficients, strict=True)])
    return rows.select("customer_id", F.inline(items))


def ablation_contributions(model: Model, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Contributions for any model: prediction minus the one with the feature at its mean.

    One pass for all features: a row unfolds to its copies with one feature levelled, and they
    are predicted where they arise.
    """
    names = list(names)
    means = features.agg(F.array(*[F.avg(n) for n in names])).scalar()
    rows = features.select("customer_id", F.array(*names).alias("_x"), means.alias("_means"))
    full = model.transform(rows.withColumn("features", array_to_vector("_x"))).select("customer_id", "_x", "_means", F.col("prediction").alias("full"))
    levelled = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda j: F.transform("_x", lambda v, i: F.when(i == j, F.get(F.col("_means"), j)).otherwise(v)))
    copies = full.select("customer_id", "full", F.posexplode(levelled).alias("_j", "_flat"))
    flat = model.transform(copies.withColumn("features", array_to_vector("_flat")))
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_j") + 1)
    return flat.select("customer_id", feature.alias("feature"), (F.col("full") - F.col("prediction")).alias("contribution"))


def global_importance(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
