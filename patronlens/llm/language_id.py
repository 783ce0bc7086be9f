"""Language identification with hyperdimensional profiles.

Every letter has a fixed pseudo-random vector of +1 and -1. A letter trigram is bound by
rotating the first letter's vector twice, the second's once, and multiplying the three. A
document is the sum of its trigram vectors; a language is the sum over its training
documents. A document gets the language whose prototype has the largest cosine with it.

Defined results: a text that is null or holds no letter gets `und` and score 0; equal
cosines go to the smaller language name; without any training row every text with letters
gets `und`, score 0. Repeated rows are judged one by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import slices

DIMENSIONS = 1024
BATCH_BYTES = 1 << 20
GRAMS_AT_ONCE = 8192
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The +1/-1 vectors of code points, from a mixing function of (code point, word of 64 signs)."""
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.view(np.uint8).reshape(len(codes), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Vectors of trigrams given as rows of three code points (0 is the gap between words)."""
    letters, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    base = letter_vectors(letters, dimensions)
    return np.roll(base, 2, axis=1)[at[:, 0]] * np.roll(base, 1, axis=1)[at[:, 1]] * base[at[:, 2]]


def count_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (n, 3) of the texts, and for every occurrence its row and trigram."""
    parts = ["" if t is None else t.lower() for t in texts]
    codes = np.frombuffer("\0".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(-1, len(parts) + 1), [0, *(len(p) + 1 for p in parts), 1])
    codes = np.where(_letter_table()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, rows = codes[keep], rows[keep]
    if len(codes) < 3:
        return np.zeros((0, 3), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    dense = np.zeros(0x110000, np.int64)
    dense[letters] = np.arange(len(letters))
    small, width = dense[codes], len(letters)
    middle = codes[1:-1] != 0
    keys = (small[:-2] * width + small[1:-1]) * width + small[2:]
    keys, rows = keys[middle], rows[1:-1][middle]
    if width**3 <= 1 << 24:  # a direct table; otherwise sort, with the same result
        found = np.zeros(width**3, bool)
        found[keys] = True
        distinct = np.flatnonzero(found)
        place = np.zeros(width**3, np.int64)
        place[distinct] = np.arange(len(distinct))
        at = place[keys]
    else:
        distinct, at = np.unique(keys, return_inverse=True)
    grams = np.stack([letters[distinct // width**2], letters[distinct // width % width], letters[distinct % width]], axis=1)
    return grams, rows, at


def bundle(texts: list[str | None], owner: np.ndarray, owners: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sum of trigram vectors for each owner; owner[i] says to which sum text i belongs."""
    total = np.zeros((owners, dimensions), np.float32)
    grams, rows, at = count_grams(texts)
    if not len(grams):
        return total
    order = np.argsort(at, kind="stable") if len(grams) > GRAMS_AT_ONCE else slice(None)
    rows, at = owner[rows[order]], at[order]
    for begin in range(0, len(grams), GRAMS_AT_ONCE):
        end = min(begin + GRAMS_AT_ONCE, len(grams))
        span = slice(np.searchsorted(at, begin), np.searchsorted(at, end)) if len(grams) > GRAMS_AT_ONCE else slice(None)
        counts = np.bincount(rows[span] * (end - begin) + at[span] - begin, minlength=owners * (end - begin))
        total += counts.reshape(owners, end - begin).astype(np.float32) @ gram_vectors(grams[begin:end], dimensions).astype(np.float32)
    return total


def fit(rows: DataFrame, text: str = "text", language: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of every non-null language, over all rows. The result has one vector a language."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "_text", BATCH_BYTES):
            names = part.column("_lang").to_pylist()
            known = sorted(set(names))
            owner = np.array([known.index(n) for n in names])
            for name, vector in zip(known, bundle(part.column("_text").to_pylist(), owner, len(known), dimensions), strict=True):
                sums[name] = sums[name] + vector if name in sums else vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"_lang": list(sums), "_sum": [v.tolist() for v in sums.values()]})

    used = rows.select(F.col(text).alias("_text"), F.col(language).cast("string").alias("_lang")).where("_lang is not null and _text is not null")
    sums = used.mapInArrow(partial, "_lang string, _sum array<double>")
    added = sums.select("_lang", F.posexplode("_sum").alias("at", "value")).groupBy("_lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in added.collect():  # one number for each language and dimension
        found.setdefault(row["_lang"], np.zeros(dimensions))[row["at"]] = row["value"]
    return found


def predict(documents: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Columns `keep`, then lang_pred and score (the cosine, not below 0), for every row."""
    names = sorted(n for n, v in prototypes.items() if np.linalg.norm(v))
    matrix = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names], np.float32).reshape(len(names), dimensions)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", BATCH_BYTES):
            vectors = bundle(part.column("_text").to_pylist(), np.arange(part.num_rows), part.num_rows, dimensions)
            norms = np.linalg.norm(vectors, axis=1)
            found = ["und"] * part.num_rows
            score = np.zeros(part.num_rows)
            if names:
                cosines = (vectors @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                best = cosines.argmax(axis=1)
                found = [names[b] if n > 0 else UNKNOWN for b, n in zip(best, norms, strict=True)]
                score = np.clip(np.where(norms > 0, cosines.max(axis=1), 0).astype(float), 0, 1)
            columns = [part.column(c) for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*(c for c in part.schema.names if c != "_text"), "lang_pred", "score"])

    used = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1]), "lang_pred string", "score double"])
    return used.mapInArrow(judge, schema)
