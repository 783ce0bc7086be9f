"""License scans: phrases word by word, notices against the edit distance of every run of words, odd rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patronlens.llm import license_scan, queries
from patronlens.llm.common import words_of

FOLDER = "/root/testdata/sf0.01"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def _brute(text, known):
    """Spans from every place of every phrase and the best run of words for every notice; one notice of a kind a text."""
    words, out = words_of(text), []
    for t in known:
        n = len(t.words)
        if t.exact:
            out += [{"label": t.label, "start": i, "end": i + n, "similarity": 1.0, "exact": True} for i in range(len(words)) if tuple(words[i : i + n]) == t.words]
            continue
        runs = [(_distance(words[i : i + m], t.words), i, i + m) for i in range(len(words)) for m in range(n - t.edits, n + t.edits + 1) if i + m <= len(words)]
        if runs and min(runs)[0] <= t.edits:
            edits, start, end = min(runs)
            out.append({"label": t.label, "start": start, "end": end, "similarity": 1 - edits / n, "exact": False})
    return license_scan.resolve(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9 .é\n中-z"), max_size=60), min_size=1, max_size=5), st.integers(1, 9))
def test_words_are_those_of_the_pattern(texts, piece):
    data = "".join(texts).encode()
    begins = np.cumsum([0] + [len(t.encode()) for t in texts])
    old, license_scan.PIECE = license_scan.PIECE, piece
    try:
        hashes, places = license_scan.WordHashes()(np.frombuffer(data, np.uint8), begins[:-1])
    finally:
        license_scan.PIECE = old
    words = [w for t in texts for w in words_of(t)]
    counts = np.diff(np.searchsorted(places, begins))
    assert counts.tolist() == [len(words_of(t)) for t in texts] and len(hashes) == len(words)
    by_word = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


MIT = license_scan.NOTICES[0][1]
TEXTS = [
    (1, None), (2, ""), (3, "..."), (4, "Under the MIT License."), (5, "under the mit\nLICENSE, under the mit license under the mit"),
    (6, "x " * 5000 + "CC-BY-NC and Apache License: version 2 y" + " cc by nc" * 2500), (7, MIT), (8, MIT.replace("person", "one nice human").replace("free", "")),
    (9, " ".join(w for i, w in enumerate(MIT.split()) if i % 3)), (10, "This work is licensed under the GNU General Public License, version 2."),
    (11, "licensed under the GNU Lesser General Public License version 3; licensed under CC BY SA 4.0"), (12, "license license license the the the mit mit mit"),
    (4, "Under the MIT License."), (None, "Under the MIT License."), (13, "you can redistribute it and modify it under terms of the GNU Affero General Public License as published by the Free Software Foundation either version 3"),
    (14, "words before " + license_scan.NOTICES[2][1] + " words after, licensed under cc by 4 0"),
]


@pytest.mark.parametrize(("piece", "most"), [(1 << 20, 8192), (64, 5)])
def test_against_every_run_of_words(spark, monkeypatch, piece, most):
    monkeypatch.setattr(license_scan, "PIECE", piece)
    monkeypatch.setattr(license_scan, "LIST", most)
    known = license_scan.templates()
    frame = spark.createDataFrame([(i, t, "q", 5, i) for i, t in TEXTS], "doc_id long, text string, template string, n_words int, _key long")
    rows = license_scan.scan(frame, ["doc_id", "n_words"]).collect()
    got = sorted(((str(r.doc_id), r.n_words_in, r.n_words, [s.asDict() for s in r.spans]) for r in rows), key=str)
    assert got == sorted(((str(i), 5, len(words_of(t)), _brute(t, known) if len(words_of(t)) < 1000 else _exact(t, known)) for i, t in TEXTS), key=str)


def _exact(text, known):
    return _brute(text, [t for t in known if t.exact])


def test_own_templates_and_empty_table(spark):
    known = license_scan.templates([], [("house", "all rights of the red house are reserved by the red house company for ever")])
    frame = spark.createDataFrame([(1, "All rights of the old red house are reserved, by the red house company, for ever!"), (2, "all rights reserved")], "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in license_scan.scan(frame, ["doc_id"], known=known).collect()}
    assert [(s.label, s.start, s.end) for s in rows[1]] == [("house", 0, 16)] and rows[1][0].similarity == 1 - 1 / 15 and rows[2] == []
    assert license_scan.scan(frame.limit(0), ["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="words"):
        license_scan.templates([("x", "two words")])


def test_query_on_the_given_table(spark):
    known = [t for t in license_scan.templates() if t.exact]
    rows = {r.doc_id: r for r in queries.QUERIES["op13_license_scan"](spark, FOLDER).collect()}
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(documents)
    for d in documents:
        spans, r = _brute(d.text, known), rows[d.doc_id]
        starts = [s["start"] for s in spans]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words_of(d.text)), len(spans), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({s["label"] for s in spans})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert ("gpl-3" in r.labels.split(",")) == ("GNU General Public License, version 3" in (d.text or ""))
        assert r.score == (1.0 if r.labels else 0.0) or 0.8 <= r.score < 1
