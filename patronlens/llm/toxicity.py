"""Toxicity from a weighted finite-state pattern grammar.

Five small transducers are composed into one table: negation and reported speech weaken the
insults and threats behind them, a target near an insult strengthens it, and a threat counts
when a target follows. The composed machine runs over the clauses of a text that hold an
insult or a threat; a clause's score is the sum over its matches, and a logistic model turns
the clause scores of a document into its score.

Insults (words, and stems with several endings) and their weights are learned from labelled
documents by their odds, with a bound against chance; so is the logistic model. Learning
uses at most `TRAIN_DOCUMENTS` labelled rows, those with the smallest hash of the id.
Scoring covers every row and every word.

Defined results: a null or empty text has no match and gets the model's base score; without
labels of both kinds there is no insult to match and the base score is the share of toxic
labels (0 without any). Null ids and labels other than 0 and 1 are not learned from.
Repeated rows are scored one by one. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import slices

TRAIN_DOCUMENTS = 12_000
BATCH_BYTES = 1 << 20
CACHED_WORDS = 400_000
STEM_LENGTHS = range(3, 9)
CHANCE = 1e-5
THREAT_WEIGHT = 4.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED, END = range(8)
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")

#: Closed word classes of the grammar in English, German, French and Spanish.
THREATS = "kill kills killing murder hurt destroy beat strangle shoot stab burn töten umbringen erschießen verletzen zerstören tuer tuerai frapper détruire matar mataré golpear destruir".split()
TARGETS = "you your yours yourself he she they him her them his their du dich dir dein deine ihr euch er tu toi vous ton votre il elle ils tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not never no neither nor cannot isn aren don nicht nie kein keine niemals pas jamais aucun nunca jamás ningún ninguna".split()
REPORTS = "said says say told wrote writes claimed claims reported called quoted according sagte sagt schrieb behauptete nannte dit écrit affirme selon dijo dice escribió afirmó según".split()


@dataclass(frozen=True)
class Transducer:
    """(state, symbol) -> (state, symbol out, factor); absent pairs keep state `fall` and the symbol."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    states: int


def window(trigger: int, into: dict[int, tuple[int, float]], length: int, swallow: bool = True) -> Transducer:
    """For `length` tokens after `trigger`, symbols in `into` are written as (symbol, factor)."""
    arcs = {}
    for state in range(length + 1):
        for symbol in range(AIMED + 1):
            out, factor = into.get(symbol, (symbol, 1.0)) if state else (symbol, 1.0)
            if symbol == trigger:
                arcs[state, symbol] = (length, OTHER if swallow else symbol, 1.0)
            else:
                arcs[state, symbol] = (max(state - 1, 0), out, factor)
    return Transducer(arcs, length + 1)


def negation(length: int = 3, factor: float = 0.3) -> Transducer:
    return window(NEGATION, {INSULT: (INSULT, factor), THREAT: (OTHER, factor)}, length)


def reported_speech(length: int = 12, factor: float = 0.5) -> Transducer:
    return window(REPORT, {INSULT: (INSULT, factor), THREAT: (THREAT, factor)}, length)


def threat(length: int = 5) -> Transducer:
    """A threat is only a threat once a target follows: the target is written as the threat."""
    base = window(THREAT, {}, length)
    arcs = dict(base.arcs)
    for state in range(1, length + 1):
        arcs[state, TARGET] = (0, THREAT, 1.0)
    return Transducer(arcs, base.states)


def target(length: int = 4, factor: float = 1.5) -> Transducer:
    """Insults shortly after a target are aimed."""
    return window(TARGET, {INSULT: (AIMED, factor)}, length)


def insult(length: int = 3, factor: float = 1.2) -> Transducer:
    """Insults close behind another insult strengthen each other."""
    base = window(INSULT, {}, length, swallow=False)
    arcs = dict(base.arcs)
    for state in range(1, length + 1):
        arcs[state, INSULT] = (length, INSULT, factor)
    return Transducer(arcs, base.states)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What `first` writes is what `second` reads; factors multiply."""
    arcs = {}
    for (state, symbol), (into, middle, factor) in first.arcs.items():
        for other in range(second.states):
            after, out, more = second.arcs[other, middle]
            arcs[state * second.states + other, symbol] = (into * second.states + after, out, factor * more)
    return Transducer(arcs, first.states * second.states)


@lru_cache(maxsize=1)
def grammar() -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """The composed machine as tables by state and symbol: next state, symbol out, factor."""
    machine = reduce(compose, (reported_speech(), negation(), insult(), threat(), target()))
    shape = range(machine.states)
    rows = [[machine.arcs[s, c] for c in range(AIMED + 1)] for s in shape]
    return [[a[0] for a in r] for r in rows], [[a[1] for a in r] for r in rows], [[a[2] for a in r] for r in rows]


@dataclass(frozen=True)
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    base: float = 0.0


class _Classes(dict):
    """Symbol and insult weight of a word; filled on demand."""

    def __init__(self, model: Model):
        super().__init__({w: (s, 0.0) for s, own in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in own})
        self.update({c: (END, 0.0) for c in ".!?;:\n"})
        self.update({w: (INSULT, v) for w, v in model.words.items()})
        self.fixed = dict(self)
        self.stems = model.stems
        self.lengths = sorted({len(s) for s in model.stems})

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > CACHED_WORDS:
            self.clear()
            self.update(self.fixed)
        weight = max((self.stems.get(word[:n], 0.0) for n in self.lengths if n < len(word)), default=0.0)
        self[word] = found = (INSULT, weight) if weight else (OTHER, 0.0)
        return found


def clause_scores(tokens: list[tuple[int, float]]) -> tuple[list[float], int, float]:
    """Scores of the clauses with a match, number of matches, sum of plain insult weights."""
    step, out, factor = grammar()
    scores, hits, plain = [], 0, 0.0
    begin = 0
    for at in [*(i for i, t in enumerate(tokens) if t[0] == END), len(tokens)]:
        clause = tokens[begin:at]
        begin = at + 1
        if not any(t[0] in (INSULT, THREAT) for t in clause):
            continue
        state, score = 0, 0.0
        for symbol, weight in clause:
            written, share = out[state][symbol], factor[state][symbol]
            state = step[state][symbol]
            if written in (INSULT, AIMED):
                score += weight * share
                plain += weight
                hits += 1
            elif written == THREAT:
                score += THREAT_WEIGHT * share
                hits += 1
        if score > 0:
            scores.append(score)
    return scores, hits, plain


def features(texts: list[str | None], model: Model, classes: _Classes | None = None) -> np.ndarray:
    """Document features from the clause scores, a row a text."""
    classes = classes if classes is not None else _Classes(model)
    out = np.zeros((len(texts), 7))
    for row, text in enumerate(texts):
        tokens = list(map(classes.__getitem__, _TOKENS.findall(text.lower()))) if text else []
        scores, hits, plain = clause_scores(tokens) if any(t[0] in (INSULT, THREAT) for t in tokens) else ([], 0, 0.0)
        out[row] = (1, math.log1p(sum(scores)), math.log1p(len(scores)), math.log1p(max(scores, default=0.0)), math.log1p(hits), bool(scores) * math.log((hits + 0.5) / (len(tokens) + 50)), math.log1p(max(hits - 1, 0)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        weights = weights + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights)), slope)
    return weights


def _weight(toxic: float, clean: float, toxic_rows: int, clean_rows: int) -> float:
    """Log odds of a term, 0 where chance may explain them (a Chernoff bound on the toxic share of its rows)."""
    p, n = toxic_rows / (toxic_rows + clean_rows), toxic + clean
    q = min(toxic / n, 1 - 1e-12)
    if q <= p or n * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p))) < -math.log(CHANCE):
        return 0.0
    odds = math.log((toxic + 0.5) / (toxic_rows + 1)) - math.log((clean + 0.5) / (clean_rows + 1))
    return round(odds, 6) if odds >= 1.5 else 0.0


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS, document_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn insults, stems and the logistic model from a bounded sample of labelled documents."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(document_id).isNotNull())
        .groupBy(F.col(document_id).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most).cache()
    )
    kinds = {r["_label"]: r["count"] for r in chosen.groupBy("_label").count().collect()}
    toxic_rows, clean_rows = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic_rows or not clean_rows:
        return Model(base=float(bool(toxic_rows)))
    sample = documents.select(F.col(document_id).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id").select("_text", "_label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for one, kind in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                found[kind].update({w for w in _TOKENS.findall((one or "").lower()) if len(w) > 1})
        words = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "c": pa.array([found[0][w] for w in words], pa.int64()), "t": pa.array([found[1][w] for w in words], pa.int64())})

    words = sample.mapInArrow(count, "word string, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).cache()
    stems = words.select("word", "c", "t", F.explode(F.array(*[F.lit(n) for n in STEM_LENGTHS])).alias("n")).where("length(word) > n")
    stems = stems.groupBy(F.expr("substring(word, 1, n)").alias("stem")).agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum((F.col("t") > 0).cast("int")).alias("kinds")).where("kinds >= 4 and t >= 5")
    single = {r["word"]: w for r in words.where("t >= 3").collect() if (w := _weight(r["t"], r["c"], toxic_rows, clean_rows))}  # words of the bounded sample
    shared = {r["stem"]: w for r in stems.collect() if (w := _weight(r["t"], r["c"], toxic_rows, clean_rows))}
    words.unpersist()
    lexicon = Model(single, shared)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(lexicon)
        for part in slices(batches, "_text", BATCH_BYTES):
            x = features(part.column("_text").to_pylist(), lexicon, classes)
            yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    rows = sorted((r["y"], r["x"]) for r in sample.mapInArrow(measure, "y int, x array<double>").collect())  # a few numbers for each sampled row
    chosen.unpersist()
    if not rows:
        return Model(base=toxic_rows / (toxic_rows + clean_rows))
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float)
    return Model(single, shared, tuple(_logistic(x, y).tolist()))


def score(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, then score, for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights = _Classes(model), np.array(model.weights)
        for part in slices(batches, "_text", BATCH_BYTES):
            if len(weights):
                x = features(part.column("_text").to_pylist(), model, classes)
                values = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            else:
                values = np.full(part.num_rows, model.base)
            names = [c for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(values, pa.float64())], [*names, "score"])

    used = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1]), "score double"])
    return used.mapInArrow(judge, schema)
