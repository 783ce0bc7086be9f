"""Merkle manifest: SQL, a plain recursive tree, odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from patronlens.checks.harness import compare, duck
from patronlens.llm import merkle, queries

FOLDER = "/root/testdata/sf0.001"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    """Root and, for every leaf, its siblings level by level."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                for leaf in owners[i]:
                    paths[leaf].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        owners = [[leaf for i in run for leaf in owners[i]] for run in runs]
        nodes = [_h(*(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def _brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted results of the query."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, _leaf(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: _tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = _tree([subs[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), subs[g][1], strict=True):
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                node = _leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in path + top:
                node = _h(*left, node, *right)
            out.append((str(row[0]), leaf, subs[g][0], root, _h(*(s for left, right in path + top for s in left + right)), node, node == root))
    return sorted(out)


def _found(spark, rows, tmp_path, name):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, root string, _idx int")
    frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((str(r[0]), *r[1:]) for r in queries.QUERIES["op12_merkle"](spark, f"{tmp_path}/{name}").collect())


def test_query_equals_sql(spark):
    assert compare(queries.QUERIES["op12_merkle"](spark, FOLDER), duck(FOLDER), queries.ORACLES["op12_merkle"]) is None


@pytest.mark.parametrize("size", [1, 9, 1100])
def test_against_a_plain_tree(spark, tmp_path, size):
    rows = [(i, f"s{i % 3}", None if i % 7 == 0 else f"l{i % 11}" if size < 20 else "é" if i % 50 == 0 else "xx", i, f"Text {i}") for i in range(size)]
    rows += [rows[0], (None, None, "zz", None, None), (None, None, "zz", None, ""), (3, None, "ü", 5, "AÉ z"), (3, None, "ü", 5, "other"), (6, "s", None, None, "Long " * 30000)]
    assert _found(spark, [(*r, "x", 1) for r in rows], tmp_path, "d") == _brute(rows)


def test_task_borders_do_not_show(spark, tmp_path):
    """One group over many tasks, and many groups in one task."""
    rows = [(i, "s", "one" if i % 3 else f"g{i}", 1, "T") for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert _found(spark, [(*r, "x", 1) for r in rows], tmp_path, "d") == _brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_clashing_kept_columns(spark, tmp_path):
    assert _found(spark, [], tmp_path, "d") == []
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "doc_id long, lang string, root string")
    made = merkle.manifest(frame, ["doc_id", "root"], keep=[F.col("doc_id"), F.col("root")])
    rows = made.proofs().collect()
    assert sorted(r.root_in for r in rows) == ["x", "y", "z"] and len({r.root for r in rows}) == 1
    assert made.root().collect()[0].root == rows[0].root and made.group_roots().count() == 3
