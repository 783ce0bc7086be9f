"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad. Emissions are linear in features of the line
and of the lines before and after it; a 2x2 matrix scores neighbouring labels. Training
takes the label of the document for each of its lines. A document's score is the mean of
the forward-backward marginals for "good", weighted by line length.

The field is fitted in numpy on a bounded sample of labelled rows: the `TRAIN_DOCUMENTS`
with the smallest hash of the id. Scoring covers every row and every line.

Defined results: a text that is null, empty or blank has no line and scores 0; without
labelled rows (or with one label only) every other text scores that label's value, 1 if
there is none. Labels other than 0 and 1, null labels and null ids are not learned from.
Repeated rows are scored one by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import crc_remainder, slices

TRAIN_DOCUMENTS = 4000
BATCH_BYTES = 1 << 20
ROUNDS = 250
FEATURES = 10


@dataclass(frozen=True)
class Field:
    """Weights of a fitted field: emission (features, 2), transition (2, 2), centring of features."""

    emission: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None


_KIND = np.zeros(0x110000, np.uint8)


def _kinds() -> np.ndarray:
    """Per code point: 1 lower or caseless letter, 2 upper-case letter, 3 digit, 4 white space, 5 anything else."""
    if not _KIND.any():
        for code in range(0x110000):
            c = chr(code)
            _KIND[code] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5
    return _KIND


def lines_of(text: str | None) -> list[str]:
    return [line for line in (text or "").split("\n") if line.strip()]


def line_features(lines: list[str]) -> np.ndarray:
    """Own features of each line, a row a line; lines are not blank."""
    if not lines:
        return np.zeros((0, FEATURES))
    codes = np.frombuffer("\n".join(["", *lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    begins = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = begins + sizes
    kind = _kinds()[codes]

    def count(mask: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(mask)])
        return (running[ends] - running[begins]).astype(float)

    other, space = kind == 5, kind == 4
    letters = np.maximum(count((kind == 1) | (kind == 2)), 1)
    doubled, closing = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    doubled[1:] = other[1:] & (codes[1:] == codes[:-1])
    closing[:-1] = other[:-1] & space[1:]
    words = [line.split() for line in lines]
    number = np.maximum(np.fromiter(map(len, words), float, len(words)), 1)
    distinct = np.fromiter((len(set(w)) for w in words), float, len(words))
    repeats = np.fromiter((sum(map(str.__eq__, w, w[1:])) for w in words), float, len(words))
    alone = np.zeros(len(codes), bool)
    alone[1:-1] = other[1:-1] & space[:-2] & space[2:]
    return np.stack([
        np.log1p(sizes), count(kind == 2) / letters, count(kind == 3) / sizes, count(other) / sizes, count(doubled) / sizes,
        count(closing) / number, distinct / number, repeats / number, np.log1p(letters / number), count(alone) / number,
    ], axis=1)


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero outside the document), edges, constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))])


def _layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of documents in the flat line table, and documents by falling number of lines."""
    return np.cumsum(counts) - counts, np.argsort(-counts, kind="stable")


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals of each line, summed pair marginals (2, 2), log partition of each document.

    `scores` are emissions, line by line, the documents one after another; all documents
    move through their lines together, so the work is a few array steps a line position.
    """
    starts, order = _layout(counts)
    alpha, beta = scores.copy(), np.zeros_like(scores)
    longest = int(counts.max(initial=0))
    live = [starts[order[: np.searchsorted(-counts[order], -t)]] + t for t in range(longest)]  # documents of over t lines
    for t in range(1, longest):
        alpha[live[t]] += _soft(alpha[live[t] - 1][:, :, None] + transition, 1)
    for t in range(longest - 1, 0, -1):
        beta[live[t] - 1] = _soft(transition + (scores[live[t]] + beta[live[t]])[:, None, :], 2)
    full = np.flatnonzero(counts)
    log_z = np.zeros(len(counts))
    log_z[full] = _soft(alpha[starts[full] + counts[full] - 1], 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    marginals = alpha + beta - log_z[owner][:, None]
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, int)
    pairs = np.exp(alpha[inner][:, :, None] + transition + (scores[inner + 1] + beta[inner + 1])[:, None, :] - log_z[owner[inner]][:, None, None]).sum(axis=0)
    return marginals, pairs, log_z


def _edges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(counts) - counts
    first, last = np.zeros(counts.sum(), bool), np.zeros(counts.sum(), bool)
    full = counts > 0
    first[starts[full]], last[(starts + counts)[full] - 1] = True, True
    return first, last


def fit_field(own: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a small ridge, by Adam over the whole sample."""
    kinds = set(labels[counts > 0].tolist())
    if len(kinds) < 2:
        return Field(np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(0), np.zeros(0), float(kinds.pop()) if kinds else 1.0)
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-6
    x = with_neighbours((own - mean) / scale, *_edges(counts))
    target = np.repeat(labels, counts)
    weight = np.repeat(1 / np.maximum(counts, 1), counts)[:, None]  # each document counts alike in the emissions
    gold = np.eye(2)[target]
    same = np.repeat(np.arange(len(counts)), counts)
    inner = same[1:] == same[:-1]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (target[:-1][inner], target[1:][inner]), 1)
    parameters = [np.zeros((x.shape[1], 2)), np.zeros((2, 2))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    for step in range(1, rounds + 1):
        marginals, pairs, _ = forward_backward(x @ parameters[0], counts, parameters[1])
        slopes = [
            x.T @ ((np.exp(marginals) - gold) * weight) / len(counts) + 1e-3 * parameters[0],
            (pairs - gold_pairs) / max(inner.sum(), 1) + 1e-3 * parameters[1],
        ]
        for p, m, g in zip(parameters, moments, slopes, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Field(parameters[0], parameters[1], mean, scale)


def score_texts(texts: list[str | None], field: Field) -> np.ndarray:
    """Length-weighted mean marginal of "good" for each text."""
    lines = [lines_of(t) for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    if field.constant is not None:
        return np.where(counts > 0, field.constant, 0.0)
    flat = [line for own in lines for line in own]
    if not flat:
        return np.zeros(len(texts))
    x = with_neighbours((line_features(flat) - field.mean) / field.scale, *_edges(counts))
    marginals, _, _ = forward_backward(x @ field.emission, counts, field.transition)
    size = np.fromiter(map(len, flat), float, len(flat))
    owner = np.repeat(np.arange(len(counts)), counts)
    good = np.bincount(owner, np.exp(marginals[:, 1]) * size, len(counts))
    return np.clip(good / np.maximum(np.bincount(owner, size, len(counts)), 1), 0, 1)


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS, document_id: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """Fit on the `most` labelled documents with the smallest hash of their id."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(document_id).isNotNull())
        .groupBy(F.col(document_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", BATCH_BYTES):
            own = [line_features(lines_of(t)).astype(np.float32).ravel() for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_label"), part.column("_hash"), pa.array([o.tobytes() for o in own], pa.binary())], ["_label", "_hash", "_own"])

    sample = documents.select(F.col(document_id).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id")
    rows = sample.select("_text", "_label", F.xxhash64("_id", "_text").alias("_hash")).mapInArrow(features, "_label int, _hash long, _own binary").collect()
    rows.sort(key=lambda r: (r["_hash"], r["_label"]))
    own = [np.frombuffer(r["_own"], np.float32).reshape(-1, FEATURES).astype(float) for r in rows]
    return fit_field(np.vstack([np.zeros((0, FEATURES)), *own]), np.array([len(o) for o in own], np.int64), np.array([r["_label"] for r in rows], np.int64))


def score(documents: DataFrame, field: Field, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, then score, for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", BATCH_BYTES):
            values = score_texts(part.column("_text").to_pylist(), field)
            names = [c for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(values, pa.float64())], [*names, "score"])

    used = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1]), "score double"])
    return used.mapInArrow(judge, schema)


def training_labels(labels: DataFrame, document_id: str = "doc_id", modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Labels that may be learned from: those outside the held-out fold."""
    return labels.where(crc_remainder(document_id, modulus) != held_out)
