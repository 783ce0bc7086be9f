import inspect
import re
from unittest import mock

import pytest

import __spark_entry__ as entry
from patronlens.operators import clustering, multi_kmeans, stability
from patronlens.plans import segment_queries


def scores(spark, pairs):
    frame = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)], "customer_id string, label_a string, label_b string")
    r = stability.agreement(frame).first()
    return r["ari"], r["nmi"], r["jaccard"]


def test_identical_and_renamed_labels(spark):
    assert scores(spark, [("a", "a"), ("a", "a"), ("b", "b"), ("c", "c")]) == pytest.approx((1.0, 1.0, 1.0))
    assert scores(spark, [("a", "z"), ("a", "z"), ("b", "y"), ("c", "x")]) == pytest.approx((1.0, 1.0, 1.0))


def test_trivial_labelings(spark):
    assert scores(spark, [("a", "a")] * 5) == pytest.approx((1.0, 1.0, 1.0))
    ari, nmi, jaccard = scores(spark, [("a", str(i)) for i in range(5)])
    assert (ari, nmi) == pytest.approx((0.0, 0.0)) and jaccard == pytest.approx(5 / 25)


def test_partial_agreement_by_hand(spark):
    # contingency [[2, 1], [0, 3]]
    ari, _, jaccard = scores(spark, [("a", "x")] * 2 + [("a", "y")] + [("b", "y")] * 3)
    s, sa, sb, e = 4, 6, 7, 6 * 7 / 15
    assert ari == pytest.approx((s - e) / ((sa + sb) / 2 - e))
    assert jaccard == pytest.approx(14 / (18 + 20 - 14))


def test_bootstrap_weights_average_one_and_are_reproducible(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20000).select(F.col("id").cast("string").alias("c"))
    w = lambda f: f.agg(F.avg(stability.bootstrap_weight(F.col("c"), 3)), F.var_pop(stability.bootstrap_weight(F.col("c"), 3))).first()
    first, second = w(ids), w(ids.repartition(17))
    assert first[0] == pytest.approx(1.0, abs=0.03) and first[1] == pytest.approx(1.0, abs=0.05) and first[0] == second[0]


@pytest.mark.parametrize("name", ["feature_sensitivity", "feature_stability", "window_consistency", "window_stability", "sampling_stability", "population_sensitivity", "kmeans_k_search"])
def test_queries_use_all_restarts_replicates_and_features(name, monkeypatch):
    """The query calls the operators with nothing that makes the job smaller; the operators' own defaults are ten and all."""
    calls, spark = [], mock.MagicMock()
    for module, operators in ((stability, ("feature_sensitivity", "feature_stability", "window_labels", "window_consistency", "window_stability", "sampling_stability", "population_sensitivity")), (clustering, ("search_k", "best_k"))):
        for operator in operators:
            own = inspect.signature(getattr(module, operator))
            monkeypatch.setattr(module, operator, lambda *a, own=own, **b: calls.append((own, own.bind(*a, **b))) or [])
    for reader in ("web_profiles", "shop_profiles", "_vectors"):
        monkeypatch.setattr(segment_queries, reader, lambda *a: None)
    getattr(segment_queries, name)(spark, "")
    assert calls
    for own, bound in calls:
        bound.apply_defaults()
        got = bound.arguments
        assert got.get("restarts", 10) == 10 and got.get("replicates", 10) == 10
        assert "names" not in got or got["names"] == own.parameters["names"].default


@pytest.mark.parametrize("name", ["kmeans_from_given_centres", "feature_sensitivity_from_given_centres", "window_consistency_from_given_centres", "critical_feature_report"])
def test_given_centres_move_as_often_as_in_the_sql(spark, name, monkeypatch):
    asked = []

    class Enough(Exception):
        pass

    def watched(rows, models, max_iter=None, tolerance=None):
        asked.append(max_iter)
        raise Enough

    monkeypatch.setattr(multi_kmeans, "fit_many", watched)
    monkeypatch.setattr(stability, "fit_many", watched)
    with pytest.raises(Enough):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    [moves] = re.findall(r"it < (\d+)", entry.oracle_sql()[name])
    assert asked == [int(moves)]
