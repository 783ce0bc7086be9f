"""Stability of labelings and robustness of segments."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.columns import clamp, ratio
from patronlens.functions.lineage import cut, few_parts
from patronlens.operators.clustering import TooFewCustomers
from patronlens.operators.features import FEATURES, cluster_features
from patronlens.operators.multi_kmeans import MAX_ITER, TOLERANCE, Fit, Model, best_of, fit_many, labels_of, moments, rows_of, scaled_view
from patronlens.operators.profiles import in_window

CRITICAL_ARI = 0.7
WINDOWS = (30, 60, 90)


def common_labels(first: DataFrame, second: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Two assignments (customer_id, label) aligned on the customers both know."""
    return first.select("customer_id", *extra, F.col("label").alias("label_a")).join(
        second.select("customer_id", *extra, F.col("label").alias("label_b")), ["customer_id", *extra])


def agreement(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ARI, NMI and co-membership Jaccard of label_a and label_b, per `by` group.

    All three come from the contingency table: rows combine before the shuffle and
    what is left has one row per pair of labels, so no customer pair is formed.
    """
    by = list(by)
    cells = labels.groupBy(*by, "label_a", "label_b").agg(F.count("*").cast("double").alias("n"))
    cells = cells.withColumns({
        "a": F.sum("n").over(Window.partitionBy(*by, "label_a")), "b": F.sum("n").over(Window.partitionBy(*by, "label_b")),
    })
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    # sums over margins, written as sums over cells: sum_i f(a_i) a_i = sum_ij n_ij f(a_i)
    sums = cells.groupBy(*by).agg(
        F.sum(n).alias("total"), F.sum(n * n).alias("nn"), F.sum(n * a).alias("aa"), F.sum(n * b).alias("bb"),
        F.sum(n * F.ln(n)).alias("ln_n"), F.sum(n * F.ln(a)).alias("ln_a"), F.sum(n * F.ln(b)).alias("ln_b"),
        F.count_distinct("label_a").alias("labels_a"), F.count_distinct("label_b").alias("labels_b"))
    t = F.col("total")
    same, pairs_a, pairs_b = [(F.col(c) - t) / 2 for c in ("nn", "aa", "bb")]
    expected = F.try_divide(pairs_a * pairs_b, t * (t - 1) / 2)
    spread = (pairs_a + pairs_b) / 2 - expected
    ari = F.when(F.abs(F.coalesce(spread, F.lit(0.0))) < 1e-12, 1.0).otherwise(F.try_divide(same - expected, spread))
    mutual = (F.col("ln_n") - F.col("ln_a") - F.col("ln_b")) / t + F.ln(t)
    entropy_a, entropy_b = F.ln(t) - F.col("ln_a") / t, F.ln(t) - F.col("ln_b") / t
    nmi = (
        F.when((F.col("labels_a") == 1) & (F.col("labels_b") == 1), 1.0)
        .when(F.abs(mutual) < 1e-12, 0.0)
        .otherwise(mutual / ((entropy_a + entropy_b) / 2)))
    jaccard = F.when(t < 2, 1.0).otherwise(F.col("nn") / (F.col("aa") + F.col("bb") - F.col("nn")))
    return sums.select(*by, t.cast("bigint").alias("customers"), ari.alias("ari"), nmi.alias("nmi"), jaccard.alias("jaccard"))


def _clusterings(
    profiles: DataFrame, names: Sequence[str], k: int, seed: int, restarts: int, without: Sequence[str] = (), days: Sequence[int] = (), replicates: int = 0,
    everyone: bool = True, start: Sequence[Sequence[float]] | None = None, tolerance: float = TOLERANCE, max_iter: int = MAX_ITER,
) -> tuple[DataFrame, dict[tuple, Fit]]:
    """The rows, and the best fit of every clustering asked for; all of them move through the same scans.

    Keys are ("all",), ("without", feature), ("window", days) and ("replicate", number). Every
    clustering standardises the customers it sees. Windows with at most k customers are left out.
    `start` gives the first centres in standardised space; then one fit is all there is.
    `max_iter` is the number of moves after which a fit ends, whether or not it stands still.
    """
    restarts = 1 if start else restarts
    plain = cluster_features(profiles, names, keep=("first_seen", "last_seen"))
    latest = profiles.agg(F.max("last_seen").alias("m")).scalar()
    plain = plain.withColumn("_latest", latest)
    weights = [in_window(F.col("_latest"), F.lit(d)).cast("int") for d in days] + [bootstrap_weight(F.col("customer_id"), i) for i in range(replicates)]
    rows = few_parts(cut(rows_of(plain, "customer_id", F.array(*names), weights)))
    (n, mean, spread), *seen = moments(rows, len(names), [None, *range(len(weights))])
    plans = {}
    if everyone:
        if n < k:
            raise TooFewCustomers(f"need at least {k} customers")
        plans[("all",)] = scaled_view(mean, spread), k
    for name in without:
        plans["without", name] = scaled_view(mean, spread, without=list(names).index(name)), k
    for i, d in enumerate(days):
        if seen[i][0] >= k + 1:
            plans["window", d] = scaled_view(seen[i][1], seen[i][2], i), k
    for i in range(replicates):
        at = len(days) + i
        plans["replicate", i] = scaled_view(seen[at][1], seen[at][2], at), k
    if not plans:
        return rows, {}
    begin = tuple(map(tuple, start)) if start else None
    fits = fit_many(rows, [Model(view, own, seed + i, begin) for view, own in plans.values() for i in range(restarts)], max_iter, tolerance)
    return rows, {key: best_of(fits[i * restarts : (i + 1) * restarts]) for i, key in enumerate(plans)}


def _against_all(rows: DataFrame, fits: dict[tuple, Fit], kind: str, name: str, type_: str) -> DataFrame:
    """Agreement of every clustering of a kind with the one of all customers, on the customers it has labelled."""
    keys = [key for key in fits if key[0] == kind]
    labels = labels_of(rows, "customer_id", [fits["all",], *[fits[key] for key in keys]])
    others = F.posexplode(F.slice("labels", 2, len(keys))).alias("_at", "label_b")
    names = F.array(*[F.lit(key[1]).cast(type_) for key in keys])
    pairs = labels.select("customer_id", F.col("labels")[0].alias("label_a"), others).where("label_b is not null")
    return agreement(pairs.select("customer_id", F.element_at(names, F.col("_at") + 1).alias(name), "label_a", "label_b"), (name,))


def feature_sensitivity(
    profiles: DataFrame, k: int = 5, seed: int = 42, threshold: float = CRITICAL_ARI, restarts: int = 10,
    names: Sequence[str] = FEATURES, start: Sequence[Sequence[float]] | None = None, tolerance: float = TOLERANCE, max_iter: int = MAX_ITER,
) -> DataFrame:
    """One row per left-out feature: agreement with the full clustering and whether it is critical.

    `start` gives the first centres of every clustering, in place of seeded restarts.
    """
    return _sensitivity(*_clusterings(profiles, names, k, seed, restarts, without=names, start=start, tolerance=tolerance, max_iter=max_iter), threshold)


def _sensitivity(rows: DataFrame, fits: dict[tuple, Fit], threshold: float) -> DataFrame:
    found = _against_all(rows, fits, "without", "dropped_feature", "string")
    return found.select("dropped_feature", "customers", "ari", (F.col("ari") < threshold).alias("is_critical"))


def feature_stability(sensitivity: DataFrame) -> DataFrame:
    return sensitivity.agg(
        F.count("*").alias("tested"), F.count_if(~F.col("is_critical")).alias("stable"),
        F.coalesce(F.avg((~F.col("is_critical")).cast("double")), F.lit(0.0)).alias("feature_stability"))


def window_labels(
    profiles: DataFrame, days: Sequence[int] = WINDOWS, k: int = 5, seed: int = 42, restarts: int = 10,
    names: Sequence[str] = FEATURES, start: Sequence[Sequence[float]] | None = None, tolerance: float = TOLERANCE, max_iter: int = MAX_ITER,
) -> DataFrame | None:
    """Labels per trailing window; windows with at most k customers are skipped. `start` as in `feature_sensitivity`."""
    return _window_labels(*_clusterings(profiles, names, k, seed, restarts, days=days, everyone=False, start=start, tolerance=tolerance, max_iter=max_iter))


def _window_labels(rows: DataFrame, fits: dict[tuple, Fit]) -> DataFrame | None:
    keys = [key for key in fits if key[0] == "window"]
    if not keys:
        return None
    days = F.array(*[F.lit(key[1]).cast("bigint") for key in keys])
    labels = labels_of(rows, "customer_id", [fits[key] for key in keys]).select("customer_id", F.posexplode("labels").alias("_at", "label"))
    return cut(labels.where("label is not null").select("customer_id", "label", F.element_at(days, F.col("_at") + 1).alias("window_days")))


def window_consistency(labels: DataFrame) -> DataFrame:
    """Agreement of every pair of windows on their common customers."""
    first = labels.select("customer_id", F.col("window_days").alias("window_a"), F.col("label").alias("label_a"))
    second = labels.select("customer_id", F.col("window_days").alias("window_b"), F.col("label").alias("label_b"))
    # a customer has one label per window, so this join yields at most one row per pair of windows
    pairs = first.join(second, "customer_id").where(F.col("window_a") < F.col("window_b"))
    return agreement(pairs, ("window_a", "window_b")).where(F.col("customers") >= 2)


def window_stability(pairs: DataFrame, threshold: float = CRITICAL_ARI) -> DataFrame:
    mean = F.coalesce(F.avg("ari"), F.lit(1.0))
    return pairs.agg(mean.alias("time_consistency"), F.count("*").alias("pairs")).withColumn(
        "stable_across_windows", F.col("time_consistency") >= threshold)


#: Cumulative Poisson(1) probabilities for 0, 1, 2, ... draws, as far as a draw of 52 bits can tell them apart.
POISSON_ONE = tuple(accumulate(exp(-1) / factorial(n) for n in range(18)))


def bootstrap_weight(customer: Column, replicate: int) -> Column:
    """How often a customer is drawn: Poisson(1) by inverse distribution of a hash.

    It depends on the customer and the replicate only, hence not on partitioning.
    """
    draw = F.pmod(F.xxhash64(customer, F.lit(replicate)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    count = F.lit(0)
    for limit in POISSON_ONE:
        count = count + (draw >= limit).cast("int")
    return count


def sampling_stability(
    profiles: DataFrame, replicates: int = 10, k: int = 5, seed: int = 42, restarts: int = 10, names: Sequence[str] = FEATURES,
) -> DataFrame:
    """Agreement of every bootstrap clustering with the one of all customers."""
    return _sampling(*_clusterings(profiles, names, k, seed, restarts, replicates=replicates))


def _sampling(rows: DataFrame, fits: dict[tuple, Fit]) -> DataFrame:
    return _against_all(rows, fits, "replicate", "replicate", "bigint").select("replicate", "customers", "ari")


def robustness_tier(overall: Column) -> Column:
    return F.when(overall >= 0.75, "HIGH").when(overall >= 0.5, "MEDIUM").otherwise("LOW")


def composite_robustness(feature: Column, time: Column, sampling: Column, threshold: Column) -> Column:
    """Sampling counts only when a threshold score is present as well."""
    return F.when(sampling.isNotNull() & threshold.isNotNull(), 0.4 * feature + 0.3 * time + 0.2 * sampling + 0.1 * threshold).otherwise(
        0.6 * feature + 0.4 * time)


def overall_robustness(feature: Column, time: Column, sampling: Column) -> Column:
    """Rule of the whole-population analysis, which does use sampling on its own."""
    return F.when(sampling.isNotNull(), 0.5 * feature + 0.3 * time + 0.2 * sampling).otherwise(0.6 * feature + 0.4 * time)


def _variation(name: str, empty: float = 1.0) -> Column:
    mean = F.avg(name)
    return F.when(mean == 0, empty).otherwise(F.stddev_pop(name) / (mean + F.lit(1e-10)))


def segment_robustness(joined: DataFrame, include_sampling: bool = False) -> DataFrame:
    """Feature, time and sampling stability of each segment from one aggregation."""
    rows = joined.select(
        "segment_id", F.col("total_revenue").cast("double").alias("revenue"), "clv_estimate",
        F.col("total_sessions").cast("double").alias("sessions"), F.col("tenure_days").cast("double").alias("tenure"))
    stats = rows.groupBy("segment_id").agg(
        F.count("*").alias("size"),
        ((_variation("revenue") + _variation("clv_estimate") + _variation("sessions")) / 3).alias("variation"),
        F.max("tenure").alias("longest"), (F.stddev_pop("tenure") / (F.avg("tenure") + F.lit(1e-10))).alias("tenure_variation"),
        (F.stddev_pop("revenue") / (F.avg("revenue") + F.lit(1e-10))).alias("revenue_variation"))
    few = F.col("size") < 3
    feature = F.when(few, 0.0).otherwise(clamp(1 - F.col("variation")))
    time = F.when(few, 0.0).when(F.col("longest") == 0, 0.5).otherwise(clamp(1 - 0.5 * F.col("tenure_variation")))
    sampling = F.lit(None).cast("double")
    if include_sampling:
        by_size = F.least(F.lit(1.0), F.col("size") / 50.0)
        by_spread = F.greatest(F.lit(0.0), 1 - 0.5 * F.col("revenue_variation"))
        sampling = F.when(few, F.lit(None)).when(F.col("size") < 5, 0.3).otherwise(0.5 * by_size + 0.5 * by_spread)
    none = F.lit(None).cast("double")
    scored = stats.select("segment_id", feature.alias("feature_stability"), time.alias("time_window_consistency"),
                          sampling.alias("sampling_stability"), none.alias("threshold_robustness"))
    scored = scored.withColumn("overall_robustness", composite_robustness(*[
        F.col(c) for c in ("feature_stability", "time_window_consistency", "sampling_stability", "threshold_robustness")]))
    return scored.withColumns({
        "robustness_tier": robustness_tier(F.col("overall_robustness")),
        "is_production_ready": F.col("overall_robustness") >= 0.5,
        "requires_monitoring": F.col("overall_robustness").between(0.5, 0.75) & (F.col("overall_robustness") < 0.75),
    })


def population_sensitivity(
    profiles: DataFrame, k: int = 5, seed: int = 42, replicates: int = 10, include_sampling: bool = True, restarts: int = 10,
) -> DataFrame:
    """One row: feature, time and sampling stability of the whole population with tier and advice."""
    rows, fits = _clusterings(profiles, FEATURES, k, seed, restarts, FEATURES, WINDOWS, replicates if include_sampling else 0)
    out = feature_stability(_sensitivity(rows, fits, CRITICAL_ARI)).select("feature_stability", "stable", "tested")
    labels = _window_labels(rows, fits)
    if labels is None:
        out = out.withColumn("time_consistency", F.lit(0.0))
    else:
        out = out.withColumn("time_consistency", window_stability(window_consistency(labels)).select("time_consistency").scalar())
    sampling = F.lit(None).cast("double")
    if include_sampling:
        sampling = _sampling(rows, fits).agg(F.coalesce(F.avg("ari"), F.lit(0.0))).scalar()
    out = out.withColumn("sampling_stability", sampling)
    score = overall_robustness(F.col("feature_stability"), F.col("time_consistency"), F.col("sampling_stability"))
    out = out.withColumn("overall_robustness", score)
    return out.withColumn("tier", robustness_tier(F.col("overall_robustness"))).withColumn(
        "advice", F.when(F.col("tier") == "HIGH", "production_ready").when(F.col("tier") == "MEDIUM", "monitor").otherwise("refine"))
