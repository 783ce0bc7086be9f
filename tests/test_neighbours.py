import math
import random

import pytest

from patronlens.operators import neighbours, whitespace

NAMES = ["a", "b", "c"]


def brute(points, queries, k):
    out = {}
    for g, qid, *q in queries:
        found = []
        for h, pid, *p in points:
            if g == h:
                found.append((-sum(x * y for x, y in zip(q, p)) / (math.hypot(*p) * math.hypot(*q)), pid) if any(p) and any(q) else (0.0, pid))
        best = sorted((s, p) for s, p in found if s < -1e-12)[:k]
        out[g, qid] = [-s for s, _ in best]
    return out


@pytest.mark.parametrize("shape", ["spread", "copies", "few"])
def test_search_equals_brute_force(spark, shape):
    rng = random.Random(7)
    vector = lambda: [rng.gauss(0, 1) for _ in NAMES]
    n = 3 if shape == "few" else 300
    points = [("g", f"p{i}", *([1.0, 2.0, 0.5] if shape == "copies" and i % 3 == 0 else vector())) for i in range(n)]
    points += [("h", f"h{i}", *vector()) for i in range(40)] + [("g", "zero", 0.0, 0.0, 0.0)]
    queries = [("g", f"q{i}", *([1.0, 2.0, 0.4] if i % 3 == 0 else vector())) for i in range(60)] + [("h", "q0", *vector()), ("none", "q1", *vector())]
    schema = "grp string, id string, a double, b double, c double"
    p = neighbours.unit(spark.createDataFrame(points, schema), NAMES)
    q = neighbours.unit(spark.createDataFrame(queries, schema), NAMES)
    got = {}
    for r in neighbours.nearest(p, q, ["grp"], NAMES, 5).orderBy("position").collect():
        got.setdefault((r["grp"], r["id"]), []).append(r["similarity"])
    for key, expected in brute(points, queries, 5).items():
        assert got.get(key, []) == pytest.approx(expected, abs=1e-9), key


def test_pairs_per_query_grow_less_than_the_points(spark):
    rng = random.Random(11)
    schema = "grp string, id string, a double, b double, c double"

    def rows(n, name):
        return neighbours.unit(spark.createDataFrame([("g", f"{name}{i}", *(rng.gauss(0, 1) for _ in NAMES)) for i in range(n)], schema), NAMES)

    queries = rows(100, "q")
    pairs = {n: neighbours.met(rows(n, "p"), queries, ["grp"], NAMES, 5)[1].count() / 100 for n in (2_000, 20_000)}
    assert pairs[20_000] < 4 * pairs[2_000] and pairs[20_000] < 2_000, pairs


def test_lookalikes_of_lists_equal_those_of_rows_and_points_are_not_salted(spark):
    rng = random.Random(3)
    names = whitespace.GENERAL_FEATURES
    rows = [("g", f"c{i}", "buyer" if i % 2 else "candidate", float(i), i, *(float(rng.randrange(4)) for _ in names)) for i in range(120)]
    schema = "grp string, customer_id string, role string, total_revenue double, total_purchases long, " + ", ".join(f"{n} double" for n in names)
    frame = spark.createDataFrame(rows, schema)
    _, found = whitespace.alike(frame, ["grp"], names)
    _, neighbours_ = whitespace.similarity(frame, ["grp"], names)
    got = {r["customer_id"]: r for r in found.collect()}
    expected = {r["customer_id"]: r for r in whitespace.lookalikes(neighbours_, ["grp"]).collect()}
    assert got.keys() == expected.keys() and len(got) > 10
    for key, row in expected.items():
        assert got[key]["similarity"] == pytest.approx(row["similarity"], abs=1e-12) and got[key]["nearest_buyers"] == row["nearest_buyers"]
    assert "_salt" not in found._jdf.queryExecution().toString()
