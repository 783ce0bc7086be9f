"""Positional index against SQL and brute force; odd rows, segments, blocks and proximity."""

import hashlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from patronlens.checks.harness import compare, duck
from patronlens.llm import decontamination, queries
from patronlens.llm.common import stored, words_in, words_of

FOLDER = "/root/testdata/sf0.001"


def _brute(documents, items, window=10):
    """(id, n_words, n_hit, items) by looking at every place."""
    runs = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            runs.setdefault(tuple(words[i : i + window]), set()).add(str(item) if item is not None else None)
    out = []
    for doc, text in documents:
        words, hit, found = words_of(text), set(), set()
        for i in range(len(words)):
            for n in {len(r) for r in runs}:
                if tuple(words[i : i + n]) in runs and i + n <= len(words):
                    hit |= set(range(i, i + n))
                    found |= runs[tuple(words[i : i + n])]
        out.append((str(doc), len(words), len(hit), tuple(sorted(f for f in found if f is not None))))
    return sorted(out)


def _found(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.items)) for r in frame.collect())


def test_query_equals_sql(spark):
    assert compare(queries.QUERIES["op2_decontamination"](spark, FOLDER), duck(FOLDER), queries.ORACLES["op2_decontamination"]) is None


@pytest.mark.parametrize(("segment", "block"), [(500_000, 8 << 20), (15, 40)])
def test_segments_blocks_and_odd_rows(spark, monkeypatch, segment, block):
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", segment)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    long = " ".join(f"w{i}" for i in range(30))
    documents = [(1, f"start {long} end"), (1, f"start {long} end"), (2, None), (3, ""), (4, "A! b, C."), (5, "b c a"), (None, "x a b c y a b c"), (6, " ".join(f"w{i}" for i in range(5, 14))), (7, " ".join(f"w{i}" for i in range(5, 15))), (8, "é É zz"), (9, "w0 " * 4000)]
    items = [(10, long), (11, "a b c"), (12, None), (13, "..."), (14, "A-B-C"), (None, "zz"), (15, "w3 w4"), (16, long + " more")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in documents], "doc_id long, text string, terms string, segment int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _found(decontamination.contamination(docs, bench, ["doc_id"])) == _brute(documents, items)
    assert _found(decontamination.contamination(docs, bench.limit(0), ["doc_id"])) == _brute(documents, [])
    assert _found(decontamination.contamination(docs.limit(0), bench, ["doc_id"])) == []
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 5, 6, 9]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big quick fox ran"), (2, "red fox quick"), (3, "red a a a a a quick a a fox"), (4, "quick fox"), (5, "red quick fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red quick fox")], "item_id long, text string")
    near = {r.doc_id: r.n_hit for r in decontamination.contamination(docs, items, ["doc_id"], slop=1).collect()}
    assert near == {1: 4, 2: 3, 3: 0, 4: 0, 5: 3}
    exact = {r.doc_id for r in decontamination.contamination(docs, items, ["doc_id"]).where("contaminated").collect()}
    assert exact == {5}


def test_digest_of_no_item(spark):
    rows = queries.QUERIES["op2_decontamination"](spark, FOLDER).where("not contaminated").collect()
    assert rows and {r.items_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}


def test_words_by_column_are_the_words_of_each_text():
    texts = [None, "", "a", "Bc", " d\x00É[e`F{g\x7f", "中 文 x", "-", "z9", "9z."]
    for column in (pa.array(texts), pa.array([*texts, "q"]).slice(2), pa.array([], pa.string())):
        words, sizes = words_in(column)
        words.validate(full=True)
        ends = np.cumsum(sizes)
        assert [words.to_pylist()[e - n : e] for e, n in zip(ends, sizes, strict=True)] == [words_of(t) for t in column.to_pylist()]


def test_order_of_codes_beyond_sixteen_bits():
    code = np.random.default_rng(1).integers(0, 200_000, 50_000).astype(np.int32)
    assert (decontamination._by_code(code) == np.argsort(code, kind="stable")).all()


def test_a_file_of_many_segments_has_small_row_groups(spark, monkeypatch):
    """A task that reads the index holds a few segments at a time, however many its file has."""
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 15)
    kept = []
    monkeypatch.setattr(decontamination, "stored", lambda frame, *args, **more: kept.append(stored(frame, *args, **more)) or kept[-1])
    docs = spark.createDataFrame([(i, f"some ten words of text {i} that go on and on") for i in range(60)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "text 7 that go on and on"), (2, "on some"), (3, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.contamination(docs, items, ["doc_id"]).collect()}
    assert got == {i: (11, 7 if i == 7 else 0) for i in range(60)}
    [file] = [f for f in kept[0].inputFiles()]
    groups = pq.ParquetFile(unquote(urlparse(file).path)).metadata
    assert groups.num_rows == 60 and max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) == decontamination.ROW_GROUP


def test_cells_of_terms_and_postings():
    terms, ends = pa.array(["b", "aä", "c"]), np.array([1, 4, 5])
    cells = pa.concat_arrays([decontamination._packed_terms(terms, ends), decontamination._cell(np.arange(5, dtype=np.int32))])
    assert [len(c.as_py()) % 8 for c in cells] == [0, 0]
    back, borders = decontamination._terms(cells[0])
    assert back.equals(terms) and borders.tolist() == [0, 1, 4, 5]
    assert np.frombuffer(cells[1].as_buffer(), np.int32)[:5].tolist() == [0, 1, 2, 3, 4]
