"""Token files: exact round trip, checksums, positions over all files."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patronlens.llm import queries, token_files
from patronlens.llm.tokens import Encoder, default_path, encoder

ODD = ["It's  <|endoftext|> x", "ÀÉ Straße ½ x²y", "Σίσυφος ΟΔΟΣ", "日本語 テスト", "áé", "'Tis don'T ''s !'s", "\x1c\x85\xa0x\x00y", "ﬁ œuvre İstanbul", "", "  "]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700))
def test_blocks_round_trip(ids):
    assert token_files.decode_block(token_files.encode_block(np.array(ids))).tolist() == ids


@pytest.mark.parametrize("n", [1, 63, 64, 129, 5000, 200_000])
def test_sizes_and_skewed_ids(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.geometric(0.01, n), 49_407), np.full(n, 49_407), rng.integers(0, 49_408, n)):
        assert (token_files.decode_block(token_files.encode_block(ids)) == ids).all()


def test_repeated_ids_get_short():
    ids = np.tile(np.arange(50), 4000)
    assert len(token_files.encode_block(ids)) * 8 / len(ids) < 2


def test_a_changed_block_is_noticed():
    payload = bytearray(token_files.encode_block(np.arange(3000) % 97))
    payload[-40] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_block(bytes(payload))


def test_encoder_gives_the_ids_of_the_library(spark):
    encode = encoder(default_path())
    texts = [*ODD, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    assert [i.tolist() for i in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode([None])[0].tolist() == []


def test_query_against_the_tokenizers_library(spark):
    folder = "/root/testdata/sf0.001"
    library, at = encoder(default_path()).tokenizer, 0
    got = {r.doc_id: r for r in queries.QUERIES["op8_token_files"](spark, folder).collect()}
    for d in sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_odd_rows(spark, monkeypatch):
    rows = [(5, "a b c", 1), (None, "x", 2), (5, "a b c", 1), (5, "d", 3), (1, None, 4), (2, "", 5), (7, "w " * 20_000, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, payload int")
    out = token_files.read_files(token_files.write_files(frame), with_ids=True).orderBy("start").collect()
    assert [r.id for r in out] == [None, 1, 2, 5, 5, 5, 7] and [r.n_tokens for r in out if r.id in (1, 2, 7)] == [1, 1, 20_001]
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])[:-1]]).tolist()
    assert all(len(r.tokens) == r.n_tokens and r.tokens[-1] == 1 for r in out)
    assert token_files.read_files(token_files.write_files(frame.limit(0))).collect() == []


def test_words_are_looked_up_once_in_a_batch():
    """All white space of Latin-1 between words gives the library's ids; a word that repeats in a batch is looked up once."""
    plain, whole = Encoder(default_path()), Encoder(default_path(), False)
    texts = [None, "", " ", "a  b\n", "\u0085x\xa0y\x0bz ", "É'll 12½ ß", "Word word wOrd " * 50]
    assert [i.tolist() for i in plain(texts)] == [i.tolist() for i in whole(texts)]
    asked = []

    class Counted(type(plain.number)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    known, plain.number = plain.number, Counted()
    plain.number.update(known)
    plain(texts)
    assert len(asked) == len(set(asked)) > 3


def test_places_and_quotients_are_those_of_whole_numbers():
    """Sorted look-ups and division as doubles give the very integers, next to every border too."""
    rng = np.random.default_rng(3)
    sums = np.concatenate([[0], np.cumsum(rng.integers(1, 90, 49_000))]).astype(np.uint64)
    values = np.concatenate([sums[:-1], sums[1:] - np.uint64(1), rng.integers(0, int(sums[-1]), 9_000).astype(np.uint64)])
    assert (token_files._places(sums, values) == np.searchsorted(sums, values, "right") - 1).all()
    assert token_files._places(sums, values[:1]).tolist() == [0]
    below = rng.integers(1, 1 << 32, 20_000).astype(np.uint64)
    whole = rng.integers(1, 1 << 16, 20_000).astype(np.uint64)
    for a in (below * whole, below * whole - np.uint64(1), below * whole + np.uint64(1)):
        assert (token_files._divided(a, below) == a // below).all()


def test_faster_coding_gives_the_same_payload():
    """The payload of a fixed block, as the plain integer code gave it."""
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(60_000) < 0.4, rng.zipf(1.3, 60_000) % 4_000, np.arange(60_000) % 37)
    payload = token_files.encode_block(ids)
    assert (len(payload), zlib.crc32(payload)) == (49768, 2936827910) and (token_files.decode_block(payload) == ids).all()
