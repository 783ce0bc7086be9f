import random

import pytest

from patronlens.operators import reports


@pytest.mark.parametrize("shape", ["even", "heavy", "constant", "tiny"])
def test_order_statistics_equal_a_sort(spark, shape):
    rng = random.Random(3)
    values = {"even": [rng.random() for _ in range(5001)], "heavy": [rng.paretovariate(0.3) for _ in range(3000)] + [0.0] * 2000,
              "constant": [4.0] * 777, "tiny": [3.0, 1.0]}[shape]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = reports.order_statistics(frame, "v", {"q25": (1, 4), "mid": (1, 2), "q75": (3, 4)}).first()
    ordered, n = sorted(values), len(values)
    assert tuple(got) == (ordered[n // 4], ordered[n // 2], ordered[3 * n // 4])


def test_loyalty_threshold_prefers_the_smaller_bucket_on_ties(spark):
    h = spark.createDataFrame([(0, 5, 0.0), (1, 5, 0.25), (2, 5, 0.5), (3, 5, 0.4)], "orders bigint, customers bigint, retention double")
    r = reports.loyalty_threshold(h).first()
    assert (r["threshold_order"], r["retention_jump"]) == (1, 0.25)
