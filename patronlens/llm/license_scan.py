"""License scans by diagonal voting: which license notices a document holds, and where.

Every run of `GRAM` words of every document is hashed and joined to the positions at which the
same run stands in a license template. A match at document word d and template word t votes
for the diagonal d - t. Votes are counted by diagonal; diagonals that lie no farther apart than
the edits a template allows are merged into one candidate, and a candidate with enough votes
is verified on the words themselves: an exact phrase word by word, a longer notice by the edit
distance to the nearest run of words around the diagonals. A template of n words allows a
fifth of n edits, fewer where that would leave no vote: every edit destroys at most GRAM of its
n - GRAM + 1 runs, so what is left is the number of votes asked for, and no notice is lost.

Where notices of different labels overlap, the more similar one stays, then the longer one.
Exact phrases always stay.

Documents are not shuffled. Templates are bounded (`MOST_WORDS`, checked) and broadcast; only
matches are kept, equal texts are counted once, and texts are read a second time for
candidates alone, behind a bitmap of fixed size. A document's own votes are all that meets in one task.

Defined results: a null text has no words; a text without a template has no spans and scores 0;
repeated documents are reported one by one; documents of any length are scanned whole, in
pieces of bounded size; an empty table gives an empty result. Other columns are ignored; kept
columns that clash with a result column come back as `<name>_in`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronlens.llm.common import slices, stored, words_of
from patronlens.llm.sieve import split_by

GRAM = 3
EDIT_SHARE = 5  # one word in five may differ
MOST_WORDS = 100_000
PIECE = 1 << 20
LIST = 8192

# Phrases that count as they stand.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Names of licenses, and the first sentences of public license notices.
NAMES = [
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("lgpl-3", "GNU Lesser General Public License, version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("agpl-3", "GNU Affero General Public License, version 3"),
    ("mpl-2", "Mozilla Public License, version 2.0"),
    ("apache-2", "Apache License, Version 2.0"),
    ("epl-2", "Eclipse Public License, version 2.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool

    @property
    def edits(self) -> int:
        return 0 if self.exact else max(0, min(len(self.words) // EDIT_SHARE, (len(self.words) - GRAM) // GRAM))

    @property
    def votes(self) -> int:
        return len(self.words) - GRAM + 1 - GRAM * self.edits


def templates(phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> list[Template]:
    """Templates of (label, text) pairs: phrases count exactly, notices within the edits allowed."""
    if notices is None:
        notices = NOTICES + [(label, f"licensed under the {name}") for label, name in NAMES]
    found = [Template(label, tuple(words_of(text)), exact) for own, exact in ((PHRASES if phrases is None else phrases, True), (notices, False)) for label, text in own]
    short = [t for t in found if len(t.words) < GRAM]
    if short or sum(len(t.words) for t in found) > MOST_WORDS:
        raise ValueError(f"templates need {GRAM} words each and {MOST_WORDS} in all at most: {short[:3]}")
    return list(dict.fromkeys(found))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of the words of texts that stand side by side in one buffer, piece by piece."""

    def __init__(self) -> None:
        self._up = self._down = _powers(_BASE, 1)

    def __call__(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first byte of each word); a word never goes on beyond the begin of a text."""
        hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        at = 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and _IS_WORD[_LOWER[data[end]]]:
                end = min(end + 64, len(data)) if _IS_WORD[_LOWER[data[end : end + 64]]].all() else end + int(np.argmin(_IS_WORD[_LOWER[data[end : end + 64]]]))
            piece = _LOWER[data[at:end]]
            word = _IS_WORD[piece]
            cut = np.zeros(len(piece) + 1, bool)
            own = begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)]
            cut[own - at] = True
            before = np.concatenate([[False], word[:-1]])
            starts = np.flatnonzero(word & (~before | cut[:-1]))
            after = np.concatenate([word[1:], [False]])
            ends = np.flatnonzero(word & (~after | cut[1:])) + 1
            if len(self._up) <= len(piece):
                self._up, self._down = _powers(_BASE, len(piece) + 1), _powers(_UNBASE, len(piece) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * self._up[: len(piece)], dtype=np.uint64)])
            hashes.append((sums[ends] - sums[starts]) * self._down[starts] * _MIX)
            places.append(starts + at)
            at = end
        return np.concatenate(hashes), np.concatenate(places)


def grams_of(hashes: np.ndarray) -> np.ndarray:
    """Hash of every run of GRAM words, as signed 64-bit integers."""
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mixed = hashes[k : k + n]
        out = (out * _BASE) + (mixed ^ (mixed >> np.uint64(31)))
    return out.view(np.int64)


def _positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(gram, template, at, edits, votes): where every run of words stands in the templates."""
    rows = []
    for number, t in enumerate(known):
        data = " ".join(t.words).encode()
        hashes, _ = WordHashes()(np.frombuffer(data, np.uint8), np.zeros(1, np.int64))
        rows += [(int(g), number, at, t.edits, t.votes) for at, g in enumerate(grams_of(hashes))]
    return spark.createDataFrame(rows, "gram long, template int, at int, edits int, votes int")


def _gram_lists(frame: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, _key, n_words, begin, grams): a head row with begin -1 for each document, and its runs in lists."""
    schema = frame.select(*keep, "_key", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("begin"), F.array(F.lit(0).cast("long")).alias("grams")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_words = WordHashes()
        for batch in slices(batches, "_text", PIECE):
            texts = pc.fill_null(batch.column("_text"), "")
            texts = texts.cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            begins = offsets - offsets[0]
            hashes, places = hash_words(data, begins[:-1])
            first = np.searchsorted(places, begins)  # words before each text
            counts = np.diff(first)
            rows, starts, cuts, parts = [], [], [0], []
            for i, n in enumerate(counts):
                own = grams_of(hashes[first[i] : first[i] + n])
                parts.append(own)
                at = np.concatenate([[-1], np.arange(0, len(own), LIST)])
                rows.append(np.full(len(at), i))
                starts.append(at)
                cuts += [cuts[-1], *(cuts[-1] + np.minimum(at[1:] + LIST, len(own))).tolist()]
            rows, starts = np.concatenate(rows), np.concatenate(starts)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))
            kept = [pc.take(batch.column(c), pa.array(rows)) for c in [*keep, "_key"]]
            made = pa.RecordBatch.from_arrays([*kept, pa.array(counts[rows], pa.int64()), pa.array(starts, pa.int64()), lists], names=schema.names)
            for begin in range(0, len(made), 64):
                yield made.slice(begin, 64)

    return frame.mapInArrow(scan, schema)


def _nearest(words: list[str], template: tuple[str, ...], begin: int, end: int) -> tuple[int, int, int]:
    """(edits, start, end) of the run of words in [begin, end) nearest to the template; leftmost, then shortest."""
    row = [(0, j) for j in range(begin, end + 1)]
    for i, word in enumerate(template, 1):
        last, row = row, [(i, begin)]
        for j in range(begin, end):
            k = j - begin
            step = last[k][0] + (words[j] != word), last[k][1]
            row.append(min(step, (last[k + 1][0] + 1, last[k + 1][1]), (row[k][0] + 1, row[k][1])))
    edits, start, stop = min((d, s, begin + k) for k, (d, s) in enumerate(row))
    return edits, start, stop


def resolve(spans: list[dict]) -> list[dict]:
    """Exact phrases, then notices from the most similar down, unless one of another label is in the way."""
    out = [s for s in spans if s["exact"]]
    for s in sorted((s for s in spans if not s["exact"]), key=lambda s: (-s["similarity"], s["start"] - s["end"], s["start"], s["label"])):
        if all(o["label"] == s["label"] or o["end"] <= s["start"] or s["end"] <= o["start"] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: (s["start"], s["end"], s["label"], s["exact"]))


_SPANS = "array<struct<label: string, start: long, end: long, similarity: double, exact: boolean>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64()), ("exact", pa.bool_())]))


def _verified(frame: DataFrame, known: list[Template]) -> DataFrame:
    """(_key, spans) of texts and their candidates."""

    def spans_of(text: str, candidates: list[dict]) -> list[dict]:
        words, found = words_of(text), []
        for c in candidates:
            t = known[c["template"]]
            size, low = len(t.words), c["low"]
            if t.exact:
                edits, start, end = 0 if low >= 0 and tuple(words[low : low + size]) == t.words else 1, low, low + size
            else:
                edits, start, end = _nearest(words, t.words, max(0, low - t.edits), min(len(words), c["high"] + size + t.edits))
            if edits <= t.edits:
                found.append({"label": t.label, "start": start, "end": end, "similarity": 1 - edits / size, "exact": t.exact})
        return resolve(found)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", PIECE):
            rows = zip(batch.column("_text").to_pylist(), batch.column("candidates").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array([spans_of(*r) for r in rows], _SPAN)], names=["_key", "spans"])

    return frame.mapInArrow(verify, frame.select("_key", F.array().cast(_SPANS).alias("spans")).schema)


def scan(documents: DataFrame, keep: list[str], text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """(keep, n_words, spans): the license spans of every document, by word positions."""
    known = templates() if known is None else known
    names = [f"_k{i}" for i in range(len(keep))]
    own = documents.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(text, F.lit("")).alias("_text"))
    own = own.withColumn("_key", F.unhex(F.sha2("_text", 256)))

    lists = _gram_lists(own, names).select(*names, "_key", "n_words", "begin", F.posexplode_outer("grams").alias("_j", "gram"))
    met = lists.join(F.broadcast(_positions(documents.sparkSession, known)), "gram", "left").where("begin = -1 or template is not null")
    met = stored(met.select(*names, "_key", "n_words", "begin", "template", "at", "edits", "votes", (F.col("begin") + F.col("_j") - F.col("at")).alias("diagonal")))
    heads = met.where("begin = -1").select(*names, "_key", "n_words")

    hits = met.where("begin >= 0").select("_key", "template", "at", "edits", "votes", "diagonal").distinct()
    lines = hits.groupBy("_key", "template", "edits", "votes", "diagonal").agg(F.count("*").alias("n"))
    along = Window.partitionBy("_key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("edits")).cast("int"), F.lit(0))
    merged = lines.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(along))
    spots = merged.groupBy("_key", "template", "votes", "cluster").agg(F.sum("n").alias("n"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")).where("n >= votes")
    spots = stored(spots.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("candidates")))

    asked = spots.select(F.xxhash64("_key").alias("_h"))
    texts, _ = split_by(own.select("_key", "_text", F.xxhash64("_key").alias("_h")), "_h", asked)
    texts = texts.groupBy("_key").agg(F.any_value("_text").alias("_text"))
    found = stored(_verified(texts.join(spots, "_key"), known).where(F.size("spans") > 0))

    with_spans, without = split_by(heads.withColumn("_h", F.xxhash64("_key")), "_h", found.select(F.xxhash64("_key").alias("_h")))
    spans = F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    clash = ("n_words", "spans")
    kept = [F.col(n).alias(f"{c}_in" if c in clash else c) for c, n in zip(keep, names, strict=True)]
    rows = with_spans.join(found, "_key", "left").select(*kept, "n_words", spans)
    return rows.unionByName(without.select(*kept, "n_words", F.array().cast(_SPANS).alias("spans")))
