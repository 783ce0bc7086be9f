import pytest
from pyspark.sql import functions as F

from patronlens.operators import scoring


def segment(spark, size=50, total=20000.0, traits=("Weekend shoppers",), dims=("WHAT",), overall=0.6):
    rows = [("s", size, total, total / size if size else 0.0, 80.0, list(traits), list(dims), ["reduce_churn"], overall, 0.5, 0.5, "MEDIUM")]
    return spark.createDataFrame(rows, "segment_id string, size bigint, total_clv double, avg_clv double, avg_order_value double, defining_traits array<string>, "
                                 "actionability_dimensions array<string>, strategic_goals array<string>, overall_robustness double, feature_stability double, "
                                 "time_window_consistency double, robustness_tier string")


def test_roi_by_hand(spark):
    r = scoring.economics(segment(spark)).first()
    assert r["campaign_cost"] == 250 and r["expected_profit"] == pytest.approx(20000 * 0.1 * 0.3 - 250)
    assert r["expected_roi"] == pytest.approx(350 / 250) and r["cost_ratio"] == pytest.approx(250 / 20000)


@pytest.mark.parametrize("change, reason", [
    ({"size": 9}, "too_small"), ({"size": 60}, "too_large"), ({"total": 999.0}, "low_total_value"), ({"overall": 0.39}, "low_robustness"),
    ({"dims": ()}, "no_actionability_dimensions"), ({"total": 7000.0}, "low_roi")])
def test_each_check_rejects_from_its_threshold(spark, change, reason):
    everyone = F.lit(110)
    assert scoring.validate(segment(spark), everyone).first()["is_valid"]
    r = scoring.validate(segment(spark, **change), everyone).first()
    assert not r["is_valid"] and reason in r["rejection_reasons"]


def test_gates_ignore_only_the_missing_dimensions(spark):
    base = scoring.validate(segment(spark, dims=()), F.lit(110)).withColumn("is_actionable", F.lit(True))
    assert scoring.usability(base).first()["is_usable"]
    assert scoring.usability(base.withColumn("is_actionable", F.lit(False))).first()["usability_reasons"] == ["not_actionable"]


def test_priority_without_viability_gets_no_roi_points(spark):
    base = segment(spark).withColumn("whitespace_value", F.lit(60000.0))
    without = scoring.priority(base.withColumn("expected_roi", F.lit(None).cast("double"))).first()["priority_score"]
    assert without == pytest.approx(10 + 5 + 12 + 15)
    assert scoring.priority(scoring.economics(base)).first()["priority_score"] == pytest.approx(without + 1.4 / 5 * 15)
