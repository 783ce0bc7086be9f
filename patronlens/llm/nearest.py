"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Every tree cuts the vectors at the median of a random direction, level by level; medians
come from a bounded sample of rows, every row is then put into its leaf of every tree. A
query walks all trees with one shared priority queue, smallest distance to a passed cut
first, and asks the leaves it reaches; their rows are reranked by the exact inner product.
Vectors get one more coordinate that makes all lengths equal, so that closeness to a cut
fits the inner product for vectors of any length.

How many leaves are asked follows from the data: `TRIALS` queries are answered by brute
force over all rows, and the number of leaves is the smallest that finds `RECALL` of their
neighbours. Equal vectors are one entry with their smallest ids, which is all that a result
can show, so a vector that a third of the rows share is no hot leaf.

Defined results: a vector that is null, zero, of another length than most, or holds a null
or non-finite component takes no part, nor does a null id; an id with several vectors asks
with the smallest of them and is a candidate with each; repeated rows count once; equal
scores go to the smaller id. Fewer candidates than asked for give fewer rows. Extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import stored

TREES = 8
LEAF = 1024
SAMPLE = 20_000
TRIALS = 128
RECALL = 0.96
FOLDED_AT_ONCE = 200_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a float64 matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; v is an array of double."""
    v = F.col(vector).cast("array<double>")
    good = F.col(row_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    found = rows.where(good).select(F.col(row_id).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    common = found.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    return found.where(F.size("v") == (common[0]["s"] if common else 0))


def folded(rows: DataFrame, most: int) -> DataFrame:
    """(rep, v, ids): each different vector with its `most` smallest ids; rep is the first of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            vectors = np.array([np.frombuffer(k) for k in held])
            out = pa.RecordBatch.from_arrays([pa.array(list(vectors), pa.list_(pa.float64())), pa.array([sorted(set(i))[:most] for i in held.values()], pa.list_(pa.int64()))], ["v", "ids"])
            held.clear()
            return out

        for batch in batches:
            for one, vector in zip(batch.column("id").to_pylist(), _matrix(batch.column("v")), strict=True):
                own = held.setdefault(vector.tobytes(), [])
                own.append(one)
                if len(own) > 4 * most:
                    own[:] = sorted(set(own))[:most]
            if len(held) > FOLDED_AT_ONCE:
                yield flush()
        if held:
            yield flush()

    parts = rows.mapInArrow(partial, "v array<double>, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)  # at most `most` ids from a task's flush
    return parts.groupBy("v").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids")


@dataclass(frozen=True)
class Forest:
    """Directions (trees, depth, dimensions + 1) and medians of each node, level by level."""

    directions: np.ndarray
    medians: list[list[np.ndarray]]
    longest: float

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def lifted(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        rest = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        full = self.lifted(vectors)
        out = np.zeros((len(self.directions), len(vectors)), np.int64)
        for tree, direction in enumerate(self.directions):
            places = full @ direction.T
            for level in range(self.depth):
                out[tree] = 2 * out[tree] + (places[:, level] >= self.medians[tree][level][out[tree]])
        return out

    def walk(self, vector: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first `most` (tree, leaf) of the shared priority queue."""
        full = self.lifted(vector[None, :], queries=True)[0]
        places = self.directions @ full
        queue = [(0.0, tree, 0, 0) for tree in range(len(self.directions))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            distance, tree, level, node = heapq.heappop(queue)
            while level < self.depth:
                gap = places[tree, level] - self.medians[tree][level][node]
                side = int(gap >= 0)
                heapq.heappush(queue, (max(distance, abs(gap)), tree, level + 1, 2 * node + 1 - side))
                node, level = 2 * node + side, level + 1
            found.append((tree, node))
        return found


def plant(sample: np.ndarray, depth: int, longest: float, trees: int = TREES, seed: int = 7) -> Forest:
    """Random directions, and medians of the sample at each node."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] + 1
    directions = rng.normal(size=(trees, depth, width))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    forest = Forest(directions, [], longest)
    full = forest.lifted(sample)
    for direction in directions:
        places, node, own = full @ direction.T, np.zeros(len(sample), np.int64), []
        for level in range(depth):
            order = np.lexsort((places[:, level], node))
            count = np.bincount(node, minlength=1 << level)
            middle = np.minimum(np.cumsum(count) - count + count // 2, len(sample) - 1)
            median = places[order[middle], level]
            own.append(median)
            node = 2 * node + (places[:, level] >= median[node])
        forest.medians.append(own)
    return forest


def _best(scores: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: pa.ListArray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its `most` best entries, best first, equal scores by id.

    Scores are recomputed for each pair alone, so that equal vectors have equal scores. The
    matrix product only sets a border: every entry at or above its `most`-th score less the
    rounding that both sums can have is recomputed, however many tie there.
    """
    wide = min(scores.shape[1], most)
    border = np.partition(scores, scores.shape[1] - wide, axis=1)[:, scores.shape[1] - wide]
    slack = 4 * vectors.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0.0)
    ends, flat = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]), ids.flatten().to_numpy()
    out = []
    for query, row, least in zip(queries, scores, border - slack, strict=True):
        own = np.flatnonzero(row >= least)
        exact = (vectors[own] * query).sum(axis=1)
        sizes = ends[own + 1] - ends[own]
        names = flat[np.repeat(ends[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        score = np.repeat(exact, sizes)
        order = np.lexsort((names, -score))[:most]
        out.append((names[order], score[order]))
    return out


def _answers(keys: list, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row a query; scores are negated, so that the natural order of a hit is best first, smaller id first."""
    ids = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
    far = -np.concatenate([np.zeros(0), *(f[1] for f in found)])
    ends = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
    hits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(far), pa.array(ids)], ["far", "id"]))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), hits], ["query", "hits"])


_HITS = "query long, hits array<struct<far: double, id: long>>"


def _merged(parts: DataFrame, most: int) -> DataFrame:
    """The `most` best of all partial answers of a query; a query has one part for each leaf it asked.

    An entry is met once in each tree, so hits repeat; sorted, equal ones are neighbours.
    """
    ranked = parts.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("all"))
    fresh = F.filter("all", lambda hit, at: (at == 0) | (hit != F.get("all", at - 1)))
    return ranked.select("query", F.slice(fresh, 1, most).alias("hits"))


def brute_force(entries: DataFrame, keys: list[int], queries: np.ndarray, most: int) -> DataFrame:
    """Exact answers to a stated, small set of queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("v"))
                yield _answers(keys, _best(queries @ vectors.T, queries, vectors, batch.column("ids"), most))

    return _merged(entries.mapInArrow(scan, _HITS), most)


def leaves_needed(forest: Forest, entries: DataFrame, queries: DataFrame, most: int, recall: float, trials: int) -> int:
    """The number of leaves after which the trial queries have `recall` of their true neighbours."""
    total = len(forest.directions) << forest.depth
    rows = queries.orderBy(F.xxhash64("rep"), "rep").limit(trials).collect()
    if not rows or not forest.depth:
        return total
    keys, vectors = [r["rep"] for r in rows], np.array([r["v"] for r in rows])
    truth = {r["query"]: [h["id"] for h in r["hits"] if h["id"] != r["query"]] for r in brute_force(entries, keys, vectors, most).collect()}
    wanted = sorted({i for own in truth.values() for i in own})  # at most trials * most ids
    frame = entries.sparkSession.createDataFrame([(i,) for i in wanted], "id long")
    where = entries.select("v", F.explode("ids").alias("id")).join(F.broadcast(frame), "id").collect()
    place = {r["id"]: forest.leaves(np.array([r["v"]]))[:, 0] for r in where}
    first = []
    for key, vector in zip(keys, vectors, strict=True):
        order = {leaf: at for at, leaf in enumerate(forest.walk(vector, total), 1)}
        first += [min(order[tree, int(leaf)] for tree, leaf in enumerate(place[i])) for i in truth[key]]
    return int(sorted(first)[min(len(first) - 1, math.ceil(recall * len(first)) - 1)]) if first else 1


def search(rows: DataFrame, is_query: Column, top: int = 20, row_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, leaf: int = LEAF, trees: int = TREES, sample: int = SAMPLE, trials: int = TRIALS) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found for each row with `is_query` (a condition on `id`)."""
    spark = rows.sparkSession
    vectors = stored(usable(rows, row_id, vector))
    entries = stored(folded(vectors, top + 1))
    size, longest = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    asked = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(asked.join(entries.select("rep", "v"), "v").select("id", "rep", "v"))
    queries = asked.select("rep", "v").dropDuplicates(["rep"])
    depth = max(0, min(math.ceil(math.log2(max(size, 1) / leaf)), int(math.log2(max(sample // 8, 1)))))
    chosen = [r["v"] for r in entries.select("v").orderBy(F.xxhash64("v")).limit(sample).collect()]
    forest = plant(np.array(chosen), depth, math.sqrt(longest), trees) if size else Forest(np.zeros((trees, 0, 1)), [[] for _ in range(trees)], 0.0)
    visits = leaves_needed(forest, entries, queries, top + 1, recall, trials)
    if not depth:
        visits = 1
    # leaves beyond the planned size, where the sample bounds the depth, are searched in parts
    parts = max(1, math.ceil(size / (leaf << depth)))
    shared = spark.sparkContext.broadcast(forest)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            places = forest.leaves(_matrix(batch.column("v")))
            for tree in range(1 if not forest.depth else len(places)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, tree), pa.int32()), pa.array(places[tree]), *batch.columns], ["tree", "leaf", *batch.schema.names])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            walks = [forest.walk(v, visits) for v in _matrix(batch.column("v"))]
            at = np.repeat(np.arange(batch.num_rows), [len(w) for w in walks])
            flat = np.array([x for w in walks for x in w], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1]), *(batch.column(c).take(pa.array(at)) for c in ("rep", "v"))], ["tree", "leaf", "rep", "v"])

    members = entries.select("rep", "v", "ids").mapInArrow(settle, "tree int, leaf long, rep long, v array<double>, ids array<long>").withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)))
    visiting = queries.select("rep", "v").mapInArrow(ask, "tree int, leaf long, rep long, v array<double>").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def rerank(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.Table.from_batches([_answers([], [])])
        own, asking = own.combine_chunks(), asking.combine_chunks()
        vectors, ids = _matrix(own.column("v").combine_chunks()), own.column("ids").combine_chunks()
        keys, points = asking.column("rep").to_pylist(), _matrix(asking.column("v").combine_chunks())
        found = []
        for begin in range(0, len(keys), 256):
            some = points[begin : begin + 256]
            found += _best(some @ vectors.T, some, vectors, ids, top + 1)
        return pa.Table.from_batches([_answers(keys, found)])

    grouping = ["tree", "leaf", "part"]
    answers = members.groupBy(*grouping).cogroup(visiting.groupBy(*grouping)).applyInArrow(rerank, _HITS)
    best = _merged(answers, top + 1)
    mine = asked.select(F.col("id").alias("query_id"), "rep").join(best, F.col("rep") == F.col("query"))
    others = mine.select("query_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, top).alias("hits"))
    return others.select("query_id", F.posexplode("hits").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
