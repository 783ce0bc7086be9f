import statistics
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronlens.operators import profiles

START = datetime(2024, 1, 15, 10)
SCHEMA = ("event_id string, customer_id string, event_type string, ts timestamp, total_amount decimal(18,2), order_total decimal(18,2), "
          "product_category string, category_level_1 string, category_level_2 string, category_level_3 string, device_type string")


def event(i, kind, customer="c", day=0.0, amount=None, order=None, cat=None, l1=None, l2=None, device=None):
    money = lambda v: None if v is None else Decimal(str(v))
    return (f"e{i}", customer, kind, START + timedelta(days=day), money(amount), money(order), cat, l1, l2, None, device)


def built(spark, rows, reference="2024-07-01 10:00:00", parts=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    if parts:
        frame = frame.repartition(parts)
    return {r["customer_id"]: r for r in profiles.build_profiles(frame, F.lit(reference).cast("timestamp")).collect()}


def test_purchase_metrics_by_hand(spark):
    rows = [event(1, "purchase", day=0, amount=100), event(2, "purchase", day=30.5, amount=0, order=50), event(3, "purchase", day=60),
            event(4, "refund", day=61, amount=20), event(5, "session_start", day=0), event(6, "add_to_cart", day=1), event(7, "add_to_cart", day=1)]
    p = built(spark, rows)["c"]
    assert p["total_purchases"] == 3 and p["total_revenue"] == Decimal("150.00")
    assert p["avg_order_value"] == pytest.approx(50.0)
    assert p["purchase_frequency_per_month"] == pytest.approx(3 / 2.0)
    assert p["days_since_last_purchase"] == 108
    assert p["refund_rate"] == pytest.approx(1 / 3)
    assert p["cart_abandonment_rate"] == 0.0
    assert p["interval_mean"] == pytest.approx(30.0) and p["interval_std"] == pytest.approx(statistics.stdev([30.5, 29.5]))
    assert p["behavior_type"] == "regular"


def test_single_and_same_day_purchases(spark):
    rows = [event(1, "purchase", "one", amount=10), event(2, "purchase", "two", amount=10), event(3, "purchase", "two", day=0.1, amount=10),
            event(4, "view_item", "none", l1="toys")]
    p = built(spark, rows)
    assert p["one"]["behavior_type"] == "one_time" and p["one"]["interval_mean"] is None
    assert p["two"]["purchase_frequency_per_month"] == 2.0 and p["two"]["interval_std"] is None and p["two"]["behavior_type"] == "new"
    assert p["none"]["clv_estimate"] == 0.0 and p["none"]["days_since_last_purchase"] is None and p["none"]["top_category"] == "toys"


def test_interval_statistics_with_repeated_instants(spark):
    days = [0, 0, 0, 0.25, 1.5, 1.5, 9, 40, 40.1]
    p = built(spark, [event(i, "purchase", day=d, amount=1) for i, d in enumerate(days)])["c"]
    gaps = [b - a for a, b in zip(days, days[1:])]
    assert p["interval_mean"] == pytest.approx(statistics.mean(gaps))
    assert p["interval_std"] == pytest.approx(statistics.stdev(gaps))
    assert p["interval_min"] == pytest.approx(min(gaps)) and p["interval_max"] == pytest.approx(max(gaps))


def test_equal_gaps_have_no_deviation(spark):
    p = built(spark, [event(i, "purchase", day=7 * i, amount=1) for i in range(40)])["c"]
    assert p["interval_std"] == pytest.approx(0.0, abs=1e-9) and p["regularity_index"] == pytest.approx(1.0)


def test_modes_take_the_first_seen_value_on_ties(spark):
    rows = [event(1, "view_item", day=3, device="Mobile"), event(2, "view_item", day=1, device="desktop")]
    p = built(spark, rows)["c"]
    assert p["primary_device_type"] == "desktop" and p["preferred_day_of_week"] == 1 and p["mobile_session_ratio"] == 0.5


def test_affinity_weights_levels_and_fallback(spark):
    rows = [event(1, "view_item", l1="a", l2="x"), event(2, "add_to_cart", l1="a"), event(3, "purchase_item", l1="b"), event(4, "view_category", cat="a"),
            event(5, "refund", l1="ghost")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {(r["level"], r["category"]): r for r in profiles.category_affinity(frame).collect()}
    assert set(found) == {(1, "a"), (1, "b"), (2, "x")}
    assert found[1, "a"]["engagement"] == 4 and found[1, "a"]["view_count"] == 2
    assert found[1, "b"]["engagement_score"] == 1.0 and found[1, "a"]["engagement_score"] == pytest.approx(0.8)


def test_refunds_above_purchases_are_clamped_but_kept_raw(spark):
    p = built(spark, [event(1, "purchase", amount=5), event(2, "refund"), event(3, "refund")])["c"]
    assert p["refund_rate"] == 1.0 and p["raw_refund_rate"] == 2.0


def test_result_does_not_depend_on_partitioning_and_a_hot_customer_is_whole(spark):
    rows = [event(i, ("purchase", "view_item", "add_to_cart")[i % 3], "hot" if i % 3 else f"u{i % 7}", day=(i * 37 % 400) / 4,
                  amount=i % 50, l1=f"k{i % 5}", device=("mobile", "desktop", None)[i % 3]) for i in range(900)]
    one, many = built(spark, rows, parts=1), built(spark, rows, parts=17)
    assert one.keys() == many.keys() and one["hot"]["total_events"] == 600
    for key in one:
        for name, value in one[key].asDict().items():
            other = many[key][name]
            assert value == pytest.approx(other) if isinstance(value, float) else value == other


def test_events_are_placed_once_before_they_unfold(spark):
    frame = spark.createDataFrame([event(i, "view_item", f"u{i % 7}", day=i, l1=f"k{i % 5}", l2=f"m{i % 3}") for i in range(50)], SCHEMA)
    for cells in (profiles.activity_cells(frame), profiles.activity_cells(frame, clock=False)):
        plan = profiles.facet_rows(cells)._jdf.queryExecution().executedPlan().toString()
        [at] = [i for i, line in enumerate(plan.splitlines()) if "Exchange" in line]
        below = plan.splitlines()[at:]
        assert not any("Generate" in line or "Aggregate" in line for line in below)
        parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert "hashpartitioning(customer_id" in below[0] and f", {parts})" in below[0] and "REPARTITION_BY_NUM" in below[0]
