"""Packing: every id exactly once, limits kept, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patronlens.llm import packing, queries
from patronlens.llm.tokens import default_path


def _padding(total):
    return 0 if total & (total - 1) == 0 else packing.TOKENS - total


def _check(pieces, lengths, free, tokens, segments, loss):
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for document, start, length, sequence, offset in pieces:
        by_document[document].append((start, length))
        by_sequence[sequence].append((offset, length, max(0, start + length - max(start, free[document]))))
    for document, total in enumerate(lengths):
        at = 0
        for start, length in sorted(by_document[document]):
            assert start == at and length > 0
            at += length
        assert at == total
    for own in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens and len(own) <= segments and sum(o[2] for o in own) <= loss


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 200)), max_size=40), st.integers(1, 6), st.integers(8, 64))
def test_limits_hold_and_every_token_is_placed_once(documents, segments, loss):
    lengths, free = np.array([d[0] for d in documents], int), np.array([min(d) for d in documents], int)
    _check(packing.pack(lengths, free, 64, segments, loss), lengths, free, 64, segments, loss)


def test_dot_product_prefers_the_example_that_uses_what_is_left():
    pieces = packing.pack(np.array([50, 40, 14, 24]), np.array([50, 0, 0, 24]), 64, 8, 40)
    first = [d for d, _, _, s, _ in pieces if s == 0]
    assert len(first) == 2 and {0, 3}.isdisjoint(first) is False


@pytest.fixture(scope="module")
def result(spark):
    folder = "/root/testdata/sf0.001"
    return queries.QUERIES["op3_packing"](spark, folder).collect(), spark.read.parquet(f"{folder}/documents.parquet").collect()


def test_query_against_the_tokenizers_library(result):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    rows, documents = result
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_document) == len(documents)
    for d in documents:
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_document[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.TOKENS and len(own) <= packing.SEGMENTS
        padding += _padding(at)
    assert padding <= 0.001 * sum(r.length for r in rows)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b", None, 1), (1, None, "q", 2), (1, None, "q", 2), (2, "", "", 3), (3, "x " * 9000, "why", 4)], "doc_id long, text string, prompt string, offset int")
    rows = packing.packed(frame, ["doc_id"], prompt="prompt", with_ids=True).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.length
        assert len(r.ids) == r.length
    assert total == {None: 3, 1: 4, 2: 1, 3: 9002}
    assert packing.packed(frame.limit(0), ["doc_id"]).collect() == []
    assert {r.doc_id for r in packing.packed(frame, ["doc_id", "prompt"]).collect()} == {None, 1, 2, 3}
