"""Many k-means fits at once: one scan of the data per step, whatever the number of models.

A model is a view of the data, a number of clusters and a seed. A view says how a row is seen:
an affine scale for every feature (zero leaves it out) and a weight (a bootstrap count, 0 or
1 for membership in a window). Restarts, values of k, left-out features, windows and replicates
are all just models, and every step moves all of them: each task folds its rows into one
partial sum per model and cluster, Spark adds those up, and models x clusters small rows come
to the driver, independent of the number of rows and tasks.

Start: k-means++ for all models together, one step a centre. A row drawn with probability
proportional to weight x squared distance is the row with the smallest -ln(u) / (weight x
distance), and u comes from a hash of row id, seed and step; so the draw is a minimum, which
merges over tasks, and it depends neither on partitioning nor on retries.

Defined results: rows with weight 0 take no part in their view and get no label there; ties go
to the smaller cluster number; a view with fewer different points than k has fewer centres; a
cluster that loses all rows keeps its centre.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4
MAX_ITER = 300
ROWS = 4096  # rows that a task looks at together


@dataclass(frozen=True)
class View:
    """Rows as (x - mean) * scale, weighted by entry `weight` of the row's weights (None: 1)."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: int | None = None


@dataclass(frozen=True)
class Model:
    """`start` gives the first centres, as seen by the view, in place of a draw."""

    view: View
    k: int
    seed: int
    start: tuple[tuple[float, ...], ...] | None = None


@dataclass(frozen=True)
class Fit:
    model: Model
    centres: np.ndarray
    sizes: np.ndarray  # weight of every cluster
    cost: float
    steps: int


def rows_of(frame: DataFrame, key: str, values: Column, weights: Sequence[Column] = ()) -> DataFrame:
    """The table that all steps read: (key, `_h`, `_x`, `_w`)."""
    weighted = F.array(*[w.cast("double") for w in weights]) if weights else F.array().cast("array<double>")
    return frame.select(key, F.xxhash64(key).alias("_h"), values.alias("_x"), weighted.alias("_w"))


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for begin in range(0, len(batch), ROWS):
            part = batch.slice(begin, ROWS)
            yield part, _matrix(part.column("_x"), len(part)), _matrix(part.column("_w"), len(part))


def _weight(view: View, w: np.ndarray, n: int) -> np.ndarray:
    return np.ones(n) if view.weight is None else w[:, view.weight]


def folded(rows: DataFrame, fold: Callable[[Iterator], list[tuple]], width: int, best: bool = False) -> dict[tuple[int, int], list]:
    """Run `fold` on every task's rows; add up (or, if `best`, take the smallest of) its (model, cluster, value...) rows."""
    names = [f"v{i}" for i in range(width)]
    arrow = pa.schema([("model", pa.int32()), ("cluster", pa.int32()), *((n, pa.float64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fold(_blocks(batches))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    parts = rows.mapInArrow(run, "model int, cluster int, " + ", ".join(f"{n} double" for n in names)).groupBy("model", "cluster")
    if best:
        merged = parts.agg(F.min(F.struct(*names)).alias("m")).select("model", "cluster", "m.*")
    else:
        merged = parts.agg(*[F.sum(n).alias(n) for n in names])
    return {(r[0], r[1]): list(r)[2:] for r in merged.collect()}  # one row a model and cluster


def moments(rows: DataFrame, width: int, weights: Sequence[int | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(total weight, mean, population deviation) of the features under each weight, in two scans for all."""

    def sums(centre: np.ndarray | None) -> Callable[[Iterator], list[tuple]]:
        def fold(blocks: Iterator) -> list[tuple]:
            total = np.zeros((len(weights), width + 1))
            for _, x, w in blocks:
                for i, at in enumerate(weights):
                    own = np.ones(len(x)) if at is None else w[:, at]
                    total[i, 0] += own.sum()
                    total[i, 1:] += own @ (x if centre is None else (x - centre[i]) ** 2)
            return [(i, 0, *row) for i, row in enumerate(total)]

        return fold

    def by_weight(found: dict) -> tuple[np.ndarray, np.ndarray]:
        table = np.array([found.get((i, 0), [0.0] * (width + 1)) for i in range(len(weights))])
        return table[:, 0], table[:, 1:] / np.maximum(table[:, :1], 1e-300)

    n, mean = by_weight(folded(rows, sums(None), width + 1))
    _, variance = by_weight(folded(rows, sums(mean), width + 1))
    return [(float(n[i]), mean[i], np.sqrt(variance[i])) for i in range(len(weights))]


def scaled_view(mean: np.ndarray, deviation: np.ndarray, weight: int | None = None, without: int | None = None) -> View:
    """Standardising view; a feature without spread is scaled by 1, feature `without` is left out."""
    scale = 1 / np.where(deviation == 0, 1.0, deviation)
    if without is not None:
        scale[without] = 0
    return View(tuple(mean), tuple(scale), weight)


def _by_view(models: Sequence[Model]) -> list[tuple[View, list[int]]]:
    views: dict[View, list[int]] = {}
    for i, m in enumerate(models):
        views.setdefault(m.view, []).append(i)
    return list(views.items())


def _seen(view: View, x: np.ndarray) -> np.ndarray:
    return (x - np.array(view.mean)) * np.array(view.scale)


def _distances(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres; centres of nan are infinitely far."""
    out = (z**2).sum(1)[:, None] - 2 * z @ np.nan_to_num(centres).T + (np.nan_to_num(centres) ** 2).sum(1)
    return np.where(np.isnan(centres[:, 0]), np.inf, np.maximum(out, 0))


def _uniform(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) from row hashes by a splitmix64 round."""
    z = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _plus_plus(rows: DataFrame, models: Sequence[Model], width: int) -> list[np.ndarray]:
    """k-means++ centres of all models; a missing centre is a row of nan."""
    # a start says nothing about a feature that the view leaves out
    centres = [np.full((m.k, width), np.nan) if m.start is None else np.array(m.start, float) * (np.array(m.view.scale) != 0) for m in models]
    views = _by_view(models)
    for step in range(max((m.k for m in models if m.start is None), default=0)):
        now = [c.copy() for c in centres]

        def fold(blocks: Iterator, step: int = step, now: list[np.ndarray] = now) -> list[tuple]:
            best: dict[int, tuple] = {}
            for batch, x, w in blocks:
                h = batch.column("_h").to_numpy(zero_copy_only=False)
                for view, own in views:
                    z, weight = _seen(view, x), _weight(view, w, len(x))
                    for i in own:
                        if step >= models[i].k or models[i].start is not None:
                            continue
                        mass = weight if step == 0 else weight * _distances(z, now[i][:step]).min(1)
                        use = mass > 0
                        if not use.any() or not np.isfinite(mass[use]).all():
                            continue
                        race = np.full(len(x), np.inf)
                        race[use] = -np.log(_uniform(h[use], models[i].seed, step)) / mass[use]
                        at = int(race.argmin())
                        best[i] = min(best.get(i, (np.inf,)), (race[at], *z[at]))
            return [(i, 0, *row) for i, row in best.items()]

        for (i, _), row in folded(rows, fold, width + 1, best=True).items():
            centres[i][step] = row[1:]
    return centres


def fit_many(rows: DataFrame, models: Sequence[Model], max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> list[Fit]:
    """Lloyd's steps for all models; one ends when its squared centre moves add up to `tolerance` at most.

    The default is meant for features of variance one.
    """
    width = len(models[0].view.mean)
    centres = _plus_plus(rows, models, width)
    sizes, costs, steps = [np.zeros(m.k) for m in models], [0.0] * len(models), [0] * len(models)
    active = set(range(len(models)))
    for step in range(max_iter + 1):
        now, moving, last = [c.copy() for c in centres], frozenset(active), step == max_iter
        views = [(v, own) for v, own in ((v, [i for i in own if i in moving]) for v, own in _by_view(models)) if own]

        def fold(blocks: Iterator, now: list[np.ndarray] = now, views: list = views) -> list[tuple]:
            stacked = [(v, own, np.concatenate([now[i] for i in own]), np.cumsum([0] + [len(now[i]) for i in own])) for v, own in views]
            total = [np.zeros((len(c), width + 2)) for _, _, c, _ in stacked]
            for _, x, w in blocks:
                for (view, _, all_centres, ends), sums in zip(stacked, total, strict=True):
                    z, weight = _seen(view, x), _weight(view, w, len(x))
                    apart = _distances(z, all_centres)
                    held = np.zeros(apart.shape)
                    for a, b in zip(ends, ends[1:], strict=False):
                        near = apart[:, a:b].argmin(1) + a
                        at = np.arange(len(x))
                        held[at, near] = weight
                    sums[:, 0] += held.sum(0)
                    sums[:, 1] += (held * np.where(np.isfinite(apart), apart, 0)).sum(0)
                    sums[:, 2:] += held.T @ z
            return [(i, c, *sums[a + c]) for (_, own, _, ends), sums in zip(stacked, total, strict=True) for i, a, b in zip(own, ends, ends[1:], strict=False) for c in range(b - a) if sums[a + c, 0] > 0]

        found = folded(rows, fold, width + 2)
        cost = dict.fromkeys(moving, 0.0)
        moved = dict.fromkeys(moving, 0.0)
        for i in moving:
            sizes[i] = np.zeros(models[i].k)
        for (i, c), (n, own, *sums) in found.items():
            cost[i] += own
            sizes[i][c] = n
            if not last:
                to = np.array(sums) / n
                moved[i] += float(((to - centres[i][c]) ** 2).sum())
                centres[i][c] = to
        for i in moving:
            costs[i], steps[i] = cost[i], step
            if moved[i] <= tolerance:
                active.discard(i)
        if not active:
            break
    return [Fit(m, centres[i], sizes[i], costs[i], steps[i]) for i, m in enumerate(models)]


def best_of(fits: Sequence[Fit]) -> Fit:
    """The fit of the smallest cost; the earlier one of equals."""
    return min(fits, key=lambda f: f.cost)


def labels_of(rows: DataFrame, key: str, fits: Sequence[Fit]) -> DataFrame:
    """(key, labels): one array a row, the cluster under every fit, null where the row's weight is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, w in _blocks(batches):
            found = np.empty((len(x), len(fits)), np.int32)
            for j, fit in enumerate(fits):
                near = _distances(_seen(fit.model.view, x), fit.centres).argmin(1)
                found[:, j] = np.where(_weight(fit.model.view, w, len(x)) > 0, near, -1)
            flat = pa.array(found.ravel(), mask=found.ravel() < 0)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fits))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, flat)], names=[key, "labels"])

    return rows.mapInArrow(run, rows.select(key, F.array().cast("array<int>").alias("labels")).schema)


def cluster_costs(rows: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """(model, cluster, size, cost): weight and summed squared distance of every cluster of every fit."""
    names = "model int, cluster int, size double, cost double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((f.model.k, 2)) for f in fits]
        for _, x, w in _blocks(batches):
            for fit, sums in zip(fits, total, strict=True):
                apart = _distances(_seen(fit.model.view, x), fit.centres)
                weight = _weight(fit.model.view, w, len(x))
                held = (apart.argmin(1)[:, None] == np.arange(fit.model.k)) * weight[:, None]
                sums[:, 0] += held.sum(0)
                sums[:, 1] += held.T @ apart.min(1)
        made = [(i, c, *row) for i, sums in enumerate(total) for c, row in enumerate(sums.tolist()) if row[0] > 0]
        yield pa.RecordBatch.from_pylist([dict(zip(("model", "cluster", "size", "cost"), m, strict=True)) for m in made], pa.schema([("model", pa.int32()), ("cluster", pa.int32()), ("size", pa.float64()), ("cost", pa.float64())]))

    return rows.mapInArrow(run, names).groupBy("model", "cluster").agg(F.sum("size").alias("size"), F.sum("cost").alias("cost"))


def silhouettes(rows: DataFrame, fits: Sequence[Fit]) -> list[float]:
    """Mean silhouette by squared distances of every fit: two scans for all, from the sums of each cluster.

    The mean squared distance to a cluster's rows follows from its size, its sum and its sum of
    squares, so no pair of rows is looked at. A row alone in its cluster has silhouette 0.
    """
    width = len(fits[0].model.view.mean)

    def near(fit: Fit, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = _seen(fit.model.view, x)
        return z, _distances(z, fit.centres).argmin(1)

    def fold(blocks: Iterator) -> list[tuple]:
        total = [np.zeros((f.model.k, width + 2)) for f in fits]
        for _, x, w in blocks:
            for fit, sums in zip(fits, total, strict=True):
                z, own = near(fit, x)
                held = (own[:, None] == np.arange(fit.model.k)) * _weight(fit.model.view, w, len(x))[:, None]
                sums[:, 0] += held.sum(0)
                sums[:, 1] += held.T @ (z**2).sum(1)
                sums[:, 2:] += held.T @ z
        return [(i, c, *row) for i, sums in enumerate(total) for c, row in enumerate(sums)]

    found = folded(rows, fold, width + 2)
    known = [np.array([found.get((i, c), [0.0] * (width + 2)) for c in range(f.model.k)]) for i, f in enumerate(fits)]

    def score(blocks: Iterator) -> list[tuple]:
        total = np.zeros((len(fits), 2))
        for _, x, w in blocks:
            for i, (fit, sums) in enumerate(zip(fits, known, strict=True)):
                z, own = near(fit, x)
                weight, n = _weight(fit.model.view, w, len(x)), sums[:, 0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = (z**2).sum(1)[:, None] + sums[:, 1] / n - 2 * z @ (sums[:, 2:] / n[:, None]).T
                    mean = np.where(n > 0, np.maximum(mean, 0), np.inf)
                    at = np.arange(len(x))
                    inner = mean[at, own] * n[own] / (n[own] - 1)
                    mean[at, own] = np.inf
                    outer = mean.min(1)
                    value = np.where((n[own] > 1) & np.isfinite(outer) & (np.maximum(inner, outer) > 0), (outer - inner) / np.maximum(inner, outer), 0.0)
                total[i] += (weight * np.nan_to_num(value)).sum(), weight.sum()
        return [(i, 0, *row) for i, row in enumerate(total)]

    sums = folded(rows, score, 2)
    return [sums[i, 0][0] / sums[i, 0][1] if (i, 0) in sums and sums[i, 0][1] else 0.0 for i in range(len(fits))]
