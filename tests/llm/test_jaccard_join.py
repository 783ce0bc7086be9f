"""Jaccard join: band choice, block pairs, odd rows and brute force."""

import itertools

import numpy as np
import pytest

from patronlens.checks.harness import compare, duck
from patronlens.llm import jaccard_join, queries
from patronlens.llm.common import words_of

FOLDER = "/root/testdata/sf0.001"


def _sets(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute(rows):
    """(id, class, copies, links) of each row."""
    sets = [_sets(t) for _, t in rows]
    key = [(i is not None, i or 0) for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, copies = [0] * len(rows), [1] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[find(a)] = find(b)
            if rows[a][1] == rows[b][1]:
                copies[a], copies[b] = copies[a] + 1, copies[b] + 1
    head = {}
    for at in range(len(rows)):
        head[find(at)] = min(head.get(find(at), key[at]), key[at])
    return sorted((str(i), str(head[find(n)][1] if head[find(n)][0] else None), copies[n], links[n]) for n, (i, _) in enumerate(rows))


def _rows(frame):
    return sorted((str(r.id), str(r.class_id), r.n_copies, r.n_links) for r in frame.collect())


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= jaccard_join.RECALL and (1 - (1 - 0.3**rows) ** bands) < 0.05


def test_query_equals_sql(spark):
    assert compare(queries.QUERIES["op10_jaccard_join"](spark, FOLDER), duck(FOLDER), queries.ORACLES["op10_jaccard_join"]) is None


@pytest.mark.parametrize("block", [512, 4])
def test_groups_of_near_copies_over_block_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(25):
        words = list(base)
        words[rng.integers(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(i + 50, t) for i, t in rows[:5]] + [(99, " ".join(rng.permutation(base).tolist())), (98, " ".join(base[:60])), (97, " ".join(base[:55]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(jaccard_join.classes(frame)) == _brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a b"), (5, "A, b!"), (5, "A, b!"), (None, "a b"), (7, "b a"), (None, None), (8, "y " * 5000), (9, "y " * 5)]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, keys string")
    assert _rows(jaccard_join.classes(frame)) == _brute(rows)
    kept = jaccard_join.representatives(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("2", "")][:0] + sorted([("3", "..."), ("None", "a b"), ("7", "b a"), ("8", "y " * 5000)])
    assert _rows(jaccard_join.classes(frame.limit(0))) == [] and jaccard_join.representatives(frame.limit(0)).collect() == []


def test_equal_ids_in_two_classes_lose_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (1, "a b c d e f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in jaccard_join.representatives(frame).collect()) == ["a b c d e f", "u v w x y z"]
