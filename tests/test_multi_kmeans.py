"""Many k-means fits in one pass: against plain Lloyd steps, weights, left-out features, partitioning, silhouettes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from patronlens.operators import clustering, features, multi_kmeans as mk


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(5)
    return np.concatenate([draw.normal(c, 1.0, (60, 3)) for c in ((0, 0, 0), (9, 0, 3), (0, 9, -3), (9, 9, 0))])


def frame_of(spark, points, weights=None, parts=3):
    rows = [(str(i), p.tolist(), [] if weights is None else [float(w[i]) for w in weights]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "customer_id string, x array<double>, w array<double>").repartition(parts, "customer_id")
    return frame.select("customer_id", F.xxhash64("customer_id").alias("_h"), F.col("x").alias("_x"), F.col("w").alias("_w"))


def lloyd(points, weight, centres):
    centres = np.array(centres, float)
    for _ in range(200):
        near = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([np.average(points[near == c], axis=0, weights=weight[near == c]) if weight[near == c].sum() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    near = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
    return centres, near, float((weight * ((points - centres[near]) ** 2).sum(1)).sum())


def test_every_model_takes_its_own_lloyd_steps(spark, points):
    draw = np.random.default_rng(1)
    weights = [draw.poisson(1, len(points)), (draw.random(len(points)) < 0.6).astype(float)]
    start = tuple(map(tuple, points[[3, 70, 130]]))
    table = frame_of(spark, points, weights)
    identity = (0.0,) * 3, (1.0,) * 3
    models = [mk.Model(mk.View(*identity), 3, 0, start), mk.Model(mk.View(*identity, 0), 3, 0, start), mk.Model(mk.View(*identity, 1), 3, 0, start),
              mk.Model(mk.View((1.0, 2.0, 3.0), (0.5, 0.0, 2.0)), 2, 0, start[:2])]
    fits = mk.fit_many(table, models, tolerance=1e-20)
    for fit, weight in zip(fits[:3], [np.ones(len(points)), *map(np.array, weights)], strict=True):
        centres, near, cost = lloyd(points, weight.astype(float), start)
        assert np.allclose(fit.centres, centres) and fit.cost == pytest.approx(cost)
        assert np.allclose(fit.sizes, [weight[near == c].sum() for c in range(3)])
    seen = (points - [1, 2, 3]) * [0.5, 0, 2]
    centres, near, cost = lloyd(seen, np.ones(len(points)), np.array(start[:2]) * [1, 0, 1])
    assert np.allclose(fits[3].centres, centres) and fits[3].cost == pytest.approx(cost)
    labels = {r.customer_id: r.labels for r in mk.labels_of(table, "customer_id", fits).collect()}
    for i in range(len(points)):
        assert labels[str(i)][3] == near[i] and (labels[str(i)][2] is None) == (weights[1][i] == 0)


def test_moments_of_all_weights(spark, points):
    weight = np.arange(len(points)) % 4
    (n, mean, spread), (m, weighted, deviation) = mk.moments(frame_of(spark, points, [weight]), 3, [None, 0])
    assert n == len(points) and np.allclose(mean, points.mean(0)) and np.allclose(spread, points.std(0))
    repeated = np.repeat(points, weight, axis=0)
    assert m == weight.sum() and np.allclose(weighted, repeated.mean(0)) and np.allclose(deviation, repeated.std(0))


def test_draws_do_not_depend_on_partitioning(spark, points):
    view = mk.View((0.0,) * 3, (1.0,) * 3)
    models = [mk.Model(view, k, s) for k in (2, 5) for s in range(3)]
    one, many = (mk.fit_many(frame_of(spark, points, parts=p), models) for p in (1, 7))
    for a, b in zip(one, many, strict=True):
        assert np.allclose(a.centres, b.centres) and a.cost == pytest.approx(b.cost)
    assert mk.best_of([f for f in one if f.model.k == 5]).cost < mk.best_of([f for f in one if f.model.k == 2]).cost


def test_draws_follow_weight_and_distance(spark):
    """The first centre is drawn by weight; copies of one point never give a second centre."""
    points, weights = np.array([[0.0], [1.0], [5.0]]), [[3.0, 1.0, 0.0]]
    view = mk.View((0.0,), (1.0,), 0)
    first = [f[0, 0] for f in mk._plus_plus(frame_of(spark, points, weights), [mk.Model(view, 1, s) for s in range(800)], 1)]
    assert 5.0 not in first and np.mean(np.array(first) == 0) == pytest.approx(0.75, abs=0.05)
    same = mk.fit_many(frame_of(spark, np.zeros((6, 1))), [mk.Model(mk.View((0.0,), (1.0,)), 3, 1)])[0]
    assert same.sizes.tolist() == [6, 0, 0] and same.cost == 0 and np.isnan(same.centres[1:]).all()


def test_silhouettes_against_all_pairs(spark, points):
    view = mk.View((0.0,) * 3, (1.0,) * 3)
    table = frame_of(spark, points)
    fits = mk.fit_many(table, [mk.Model(view, k, 3) for k in (2, 4, 6)])
    for fit, got in zip(fits, mk.silhouettes(table, fits), strict=True):
        near = ((points[:, None] - fit.centres) ** 2).sum(2).argmin(1)
        pairs = ((points[:, None] - points) ** 2).sum(2)
        values = []
        for i, own in enumerate(near):
            mates = (near == own).sum()
            inner = pairs[i][near == own].sum() / max(mates - 1, 1)
            outer = min(pairs[i][near == c].mean() for c in set(near) - {own})
            values.append((outer - inner) / max(outer, inner) if mates > 1 else 0)
        assert got == pytest.approx(np.mean(values))


def test_number_of_scans_does_not_grow_with_models(spark, points, monkeypatch):
    calls, plain = [], mk.folded
    monkeypatch.setattr(mk, "folded", lambda *a, **b: calls.append(1) or plain(*a, **b))
    view = mk.View((0.0,) * 3, (1.0,) * 3)
    for seeds in (1, 30):
        calls.clear()
        fits = mk.fit_many(frame_of(spark, points), [mk.Model(view, 4, s) for s in range(seeds)])
        assert len(calls) == 4 + max(f.steps for f in fits) + 1


def test_model_finds_the_nearest_centre(spark, points):
    names = ["a", "b", "c"]
    frame = spark.createDataFrame([(str(i), *p.tolist()) for i, p in enumerate(points)], "customer_id string, a double, b double, c double")
    vectors = features.as_vectors(frame, names)
    model = clustering.fit_kmeans(vectors, 4)
    rows = model.transform(vectors).collect()
    assert all(r.cluster == ((np.array([r.a, r.b, r.c]) - np.array(model.centres)) ** 2).sum(1).argmin() for r in rows)
    assert model.cost == pytest.approx(sum(min(((np.array([r.a, r.b, r.c]) - np.array(model.centres)) ** 2).sum(1)) for r in rows), rel=1e-3)
    assert clustering.best_k(clustering.search_k(vectors, range(2, 7), restarts=5)) == 4
    with pytest.raises(clustering.TooFewCustomers):
        clustering.fit_kmeans(vectors.limit(2), 3)


def test_fits_read_few_parts(spark):
    """Every step is a job, so a small table must not keep the many parts of the profiles."""
    frame = spark.range(0, 60, 1, 40).select(F.col("id").alias("customer_id"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("x"))
    vectors = frame.select("customer_id", array_to_vector("x").alias("features"))
    rows = clustering._rows(vectors)
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 60
    assert clustering.fit_kmeans(vectors, 3).cost < 1e-12
