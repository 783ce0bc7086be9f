"""Nearest neighbours against brute force; the language model's counts, normalisation and gain."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patronlens.llm import log_bilinear, nearest, queries

FOLDER = "/root/testdata/sf0.001"


def test_recall_order_and_scores(spark):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in queries.QUERIES["op4_nearest"](spark, FOLDER).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in table if i % 20 == 0}
    found = 0
    for query, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and query not in [r[1] for r in rows]
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        assert all(r[2] == pytest.approx(float(table[query] @ table[r[1]]), abs=1e-12) for r in rows)
        truth = sorted((-float(table[query] @ v), i) for i, v in table.items() if i != query)[:20]
        found += len({i for _, i in truth} & {r[1] for r in rows})
    assert found / (20 * len(got)) >= 0.9


def test_forest_recall_with_small_leaves(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = nearest.search(frame, F.col("id") % 50 == 0, top=10, leaf=32, trials=20).collect()
    found = 0
    for q in range(0, 1500, 50):
        truth = np.argsort(-(vectors @ vectors[q]), kind="stable")
        found += len(set([i for i in truth.tolist() if i != q][:10]) & {r.vec_id for r in rows if r.query_id == q})
    assert found / 300 >= 0.9


def test_copies_bad_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0], "x", 1) for i in range(0, 60)] + [(i, [0.0, 1.0], "x", 1) for i in range(60, 70)]
    rows += [(100, None, "x", 1), (120, [0.0, 0.0], "x", 1), (140, [1.0, None], "x", 1), (160, [float("nan"), 1.0], "x", 1), (180, [1.0], "x", 1), (None, [1.0, 0.0], "x", 1), (0, [1.0, 0.0], "x", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, id int")
    got = defaultdict(list)
    for r in nearest.search(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[40]] == list(range(20))
    assert [i for i, _ in got[60]] == [*range(61, 70), *range(11)] and got[60][0][1] == 1.0
    few = nearest.search(frame.where("vec_id in (0, 1, 61)"), F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in few] == [(1, 1), (61, 2)]
    assert nearest.search(frame.limit(0), F.col("id") == 0).collect() == []


def test_ties_of_different_vectors_go_to_the_smaller_ids(spark):
    """Query 0 scores 1 with 200 different vectors; ids and arrival run against each other."""
    rows = [(0, [1.0] + [0.0] * 8)] + [(i, [1.0, *[float(i >> k & 1) for k in range(8)]]) for i in range(200, 0, -1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = nearest.search(frame, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 21)]


def _tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def _remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("known", [log_bilinear.KNOWN_WORDS, 600])
def test_counts_and_base_score(spark, documents, monkeypatch, known):
    monkeypatch.setattr(log_bilinear, "KNOWN_WORDS", known)
    counts = Counter(t for i, text in documents if _remainder(i, 7) != 2 for t in _tokens(text))
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in queries.QUERIES["op7_log_bilinear"](spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    for i, text in documents:
        own, r = _tokens(text), rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (_remainder(i, 7) == 2, len(own), sum(counts[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_events_are_normalised():
    rng = np.random.default_rng(0)
    events = rng.integers(0, log_bilinear.OUTPUTS, 400)
    sizes = np.array([150, 0, 250])
    fitted = log_bilinear.train(events, sizes, epochs=1)
    zero = np.zeros(log_bilinear.GROUPS, np.int64)
    model = log_bilinear.Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, zero, zero, *fitted)
    before = np.array([3, 77, 5])
    total = 0.0
    for event in range(log_bilinear.OUTPUTS):
        total += 10 ** log_bilinear.event_log10(model, np.append(before, event), np.array([4]))[-1]
    assert total == pytest.approx(1, abs=1e-4)


def test_training_learns_a_pattern():
    events = np.tile([1, 2, 3, 4], 3000)
    place, source, sink, bias = log_bilinear.train(events, np.array([len(events)]))
    zero = np.zeros(log_bilinear.GROUPS, np.int64)
    model = log_bilinear.Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, zero, zero, place, source, sink, bias)
    assert log_bilinear.event_log10(model, np.tile([1, 2, 3, 4], 5), np.array([20]))[5:].mean() > -0.15


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a A b"), (3, "x y \x1c z"), (4, "w " * 9000)]
    frame = spark.createDataFrame([(i, t, True, "w") for i, t in rows], "doc_id long, text string, learned boolean, word string")
    model, counts = log_bilinear.fit(frame)
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known) for r in log_bilinear.score(frame, model, counts, ["doc_id", "word"]).collect()))
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 4, 4), ("4", 9001, 9001), ("None", 4, 4)]
    model, counts = log_bilinear.fit(frame.limit(0))
    assert model.tokens == 0 and log_bilinear.score(frame.limit(0), model, counts, ["doc_id"]).collect() == []
    unlearned = frame.withColumn("learned", F.lit(False))
    model, counts = log_bilinear.fit(unlearned)
    assert {r.n_known for r in log_bilinear.score(unlearned, model, counts, ["doc_id"]).collect()} == {0}


def test_every_stretch_of_a_long_text_is_learned(spark, monkeypatch):
    """Three thirds of one text with a cycle of words each; pieces and parts are many, their borders keep the context."""
    monkeypatch.setattr(log_bilinear, "PIECE", 1000, raising=False)
    monkeypatch.setattr(log_bilinear, "PART", 20_000, raising=False)
    cycles = [["aa", "bb", "cc", "dd"], ["ee", "ff", "gg", "hh"], ["ii", "jj", "kk", "ll"]]
    text = " ".join(" ".join(cycle * 10_000) for cycle in cycles)
    frame = spark.createDataFrame([(1, text, True)], "doc_id long, text string, learned boolean")
    model, _ = log_bilinear.fit(frame)
    number = dict(zip(model.words, model.events, strict=True))
    for cycle in cycles:
        events = np.array([number[w.encode()] for w in cycle * 5])
        assert log_bilinear.event_log10(model, events, np.array([20]))[5:].mean() > -0.3


def test_four_hundred_words_are_events_of_their_own(spark):
    words = [f"w{i}" for i in range(400)]
    frame = spark.createDataFrame([(1, " ".join(words * 5), True)], "doc_id long, text string, learned boolean")
    model, _ = log_bilinear.fit(frame)
    number = dict(zip(model.words, model.events, strict=True))
    assert len({number[w.encode()] for w in words}) == 400 and min(number[w.encode()] for w in words) > log_bilinear.GROUPS
    assert model.source.shape[1] >= 32


def test_coded_tokens_are_the_tokens_of_each_text():
    texts = [None, "", " ", "a A\tB ", "é\x1cÀ x \x0b\x0c y", "b\r\nb", "a"]
    words, codes, sizes = log_bilinear.coded(pa.array(texts, pa.string()))
    found = np.split(codes, np.cumsum(sizes)[:-1])
    assert [[words[i] for i in own] for own in found] == [log_bilinear.tokens_of(t) for t in texts]
    assert len(set(words)) == len(words)


def test_slopes_of_a_batch_and_room_of_scores():
    """A batch moves the parameters as the plain sums over its rows do; scoring holds few rows of all events at once."""
    lb, rng = log_bilinear, np.random.default_rng(5)
    events = rng.integers(0, lb.OUTPUTS, 1500)
    share = np.full(lb.OUTPUTS, 1 / lb.OUTPUTS)
    before = lb.contexts(events, np.array([1000, 3, 497]))
    parameters, squares = lb.begin_training(share, rng)
    parameters[3] = parameters[3] + rng.normal(0, 0.1, lb.OUTPUTS).astype(np.float32)
    place, source, sink, bias = (p.astype(float) for p in parameters)
    draws = np.random.default_rng(9)
    draws.permutation(len(events))
    noise = draws.choice(lb.OUTPUTS, lb.NOISE, p=share)
    slopes = [np.zeros_like(p) for p in (place, source, sink, bias)]
    for row, goal in enumerate(events):
        ctx = before[:, row]
        hidden = (place * source[ctx]).sum(axis=0)
        pull = np.zeros(lb.WIDTH)
        for out, hit in [(goal, 1), *((n, 0) for n in noise)]:
            error = (1 / (1 + np.exp(-(hidden @ sink[out] + bias[out] - np.log(lb.NOISE * share[out])))) - hit) / len(events)
            pull += error * sink[out]
            slopes[2][out] += error * hidden
            slopes[3][out] += error
        slopes[0] += source[ctx] * pull
        np.add.at(slopes[1], ctx, place * pull)
    wanted = [p - 0.15 * g / np.sqrt(1e-3 + g * g) for p, g in zip((place, source, sink, bias), slopes, strict=True)]
    lb.one_pass(parameters, squares, before, events, share, 0, np.random.default_rng(9))
    for got, own in zip(parameters, wanted, strict=True):
        assert np.allclose(got, own, atol=2e-5)
    zero = np.zeros(lb.GROUPS, np.int64)
    model = lb.Model([], np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, zero, zero, *parameters)
    tracemalloc.start()
    lb.event_log10(model, np.resize(events, 20_000), np.array([20_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_hits_that_repeat_over_the_trees_are_met_once_without_comparing_all_pairs(spark):
    parts = spark.range(0, 800).selectExpr("id % 2 as query", "transform(sequence(0, 20), i -> struct(cast(-(i + id % 97) as double) as far, i + id % 97 as id)) as hits")
    merged = nearest._merged(parts, 30)
    assert {r["query"]: [(h["far"], h["id"]) for h in r["hits"]] for r in merged.collect()} == {q: [(-float(i), i) for i in range(116, 86, -1)] for q in (0, 1)}
    assert "array_distinct" not in merged._jdf.queryExecution().optimizedPlan().toString()
