"""Log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

The model predicts one of `OUTPUTS` events from the `CONTEXT` events before it: the vector
of the next event is the sum of the context's vectors, each scaled by its place's weights;
an event's score is its dot product with that vector plus a bias. Events are the commonest
training words, the end, and groups of the other words by spelling; inside a group a word
has the add-one share of its training count, with one place for all unseen words. Scores are
normalised over all events by batched matrix products, so a text has a proper probability.

Word counts are exact and cover all training rows: tasks send partial counts, and nothing
but the `KNOWN_WORDS` commonest words (a bounded table) is broadcast; all other words of a
text are looked up by a join on the word. The neural part is fitted on every token of every
training row: texts are cut into pieces of `PIECE` events, each with the events before it as
context, and dealt by hash into parts of about `PART` events. In each epoch every part makes
one pass from the shared parameters, and their averages, weighted by events and summed in
the tasks, start the next epoch; only parameter arrays reach the driver. Scoring covers
every token of every row.

Defined results: a null text is empty, which is the end token alone; without training rows
all counts are 0 and all events are equally likely. Repeated rows are scored one by one;
null ids belong to remainder 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import slices, stored

OUTPUTS = 512
GROUPS = 96
CONTEXT = 5
WIDTH = 32
KNOWN_WORDS = 200_000
#: Events of a training piece, and of all pieces that one pass of an epoch sees.
PIECE = 1 << 15
PART = 1 << 21
NOISE = 64
EPOCHS = 4
BATCH_BYTES = 1 << 20
COUNTED_BYTES = 4 << 20
#: Rows scored together; their scores of all events stay in a core's cache.
ROWS_AT_ONCE = 256
COUNTED_AT_ONCE = 1_000_000
#: The end of a text as a token; no word is white space.
END = b"\n"


def tokens_of(text: str | None) -> list[bytes]:
    """Runs of anything but blank, tab and line ends, A-Z in lower case, then the end."""
    return [*(text.encode("utf-8", "surrogatepass").lower().split() if text else ()), END]


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of texts, the number of each token one text after another, and tokens of each text; as `tokens_of` has them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    sizes, codes = lists.value_lengths().to_numpy().astype(np.int64), flat.indices.to_numpy().astype(np.int64)
    words = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    blank = pc.index(flat.dictionary, "").as_py()
    if blank >= 0:  # beside white space at either end of a text
        real = codes != blank
        codes, owner = codes[real] - (codes[real] > blank), owner[real]
        sizes = np.bincount(owner, minlength=len(sizes))
        del words[blank]
    out = np.full(len(codes) + len(sizes), len(words), np.int64)
    out[np.arange(len(codes)) + owner] = codes
    return [*words, END], out, sizes + 1


def group_of(word: bytes) -> int:
    """Spelling group of a word outside the commonest: by its first two bytes and its last."""
    return zlib.crc32(word[:2] + word[-1:]) % GROUPS


class _Numbering(dict):
    """Numbers of words in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def count_words(rows: DataFrame, text: str, learned: str) -> DataFrame:
    """(word, c, total): occurrences in rows to learn from, and in all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sums = _Numbering(), np.zeros((2, 1 << 16), np.int64)

        def flush() -> pa.RecordBatch:
            total, seen = sums[:, : len(numbers)].copy()
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(numbers), pa.binary()), "c": pa.array(seen), "total": pa.array(total)})
            numbers.clear()
            sums[:] = 0
            return out

        for part in slices(batches, "_text", COUNTED_BYTES):
            words, codes, sizes = coded(part.column("_text"))
            learn = pc.fill_null(part.column("_learn"), False).to_numpy(zero_copy_only=False)
            at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            while len(numbers) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros_like(sums)], axis=1)
            sums[0, at] += np.bincount(codes, minlength=len(words))
            sums[1, at] += np.bincount(codes[np.repeat(learn, sizes)], minlength=len(words))
            if len(numbers) > COUNTED_AT_ONCE:
                yield flush()
        if numbers:
            yield flush()

    used = rows.select(F.col(text).alias("_text"), F.col(learned).alias("_learn"))
    return used.mapInArrow(count, "word binary, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


@dataclass(frozen=True)
class Model:
    """Parameters; `events` and `counts` belong to the commonest words, all others fall to groups."""

    words: list[bytes]
    events: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    group_tokens: np.ndarray
    group_words: np.ndarray
    place: np.ndarray
    source: np.ndarray
    sink: np.ndarray
    bias: np.ndarray

    def inside(self) -> np.ndarray:
        """log10 of one over the size of each group's add-one distribution."""
        return -np.log10(self.group_tokens + self.group_words + 1.0)


def contexts(events: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CONTEXT events before each event of its text, a row for each place, nearest first; OUTPUTS stands before the text."""
    first = np.cumsum(sizes) - sizes
    out = np.full((CONTEXT, len(events)), OUTPUTS, np.int16)
    for back in range(1, CONTEXT + 1):
        out[back - 1, back:] = events[:-back]
        for at in range(back):
            out[back - 1, first[sizes > at] + at] = OUTPUTS
    return out


def begin_training(share: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """First parameters (place weights, source and sink vectors, biases) and their Adagrad sums."""
    place = np.ones((CONTEXT, WIDTH), np.float32) / CONTEXT
    source = rng.normal(0, 0.1, (OUTPUTS + 1, WIDTH)).astype(np.float32)
    sink = rng.normal(0, 0.1, (OUTPUTS, WIDTH)).astype(np.float32)
    parameters = [place, source, sink, np.log(share).astype(np.float32)]
    return parameters, [np.full_like(p, 1e-3) for p in parameters]


def _sums_by(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, WIDTH) sums of the rows by every line of `at`, which holds numbers below n."""
    pairs = np.ascontiguousarray(rows.view(np.complex64).T)  # two columns in one sum
    out = np.zeros((pairs.shape[0], n), np.complex64)
    where = at.ravel()
    for own, values in zip(out, pairs, strict=True):
        np.add.at(own, where, np.tile(values, len(at)))
    return np.ascontiguousarray(out.T).view(np.float32)


def one_pass(parameters: list[np.ndarray], squares: list[np.ndarray], before: np.ndarray, events: np.ndarray, share: np.ndarray, epoch: int, rng: np.random.Generator) -> None:
    """One pass of noise-contrastive estimation with Adagrad over events and their contexts, in place.

    The slopes of places and sources both follow from the sums, over the rows of a batch, of the
    slope of the predicted vector by place and event there.
    """
    place, source, sink, bias = parameters
    noise_log = np.log(NOISE * share).astype(np.float32)
    before, events = np.ascontiguousarray(before), events.astype(np.int16)  # any other order in memory is copied by each take
    order = rng.permutation(len(events))
    spots = np.arange(CONTEXT)[:, None] * (OUTPUTS + 1)
    for begin in range(0, len(order), 2048):
        rows = order[begin : begin + 2048]
        at, goal = before.take(rows, axis=1) + spots, events.take(rows).astype(np.int64)
        noise = rng.choice(OUTPUTS, NOISE, p=share)
        scaled = (place[:, None, :] * source).reshape(-1, WIDTH)
        hidden = scaled.take(at[0], axis=0)
        for own in at[1:]:
            hidden += scaled.take(own, axis=0)
        aims, lures, base = sink.take(goal, axis=0), sink[noise], bias - noise_log
        good = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", hidden, aims) + base[goal])))
        bad = hidden @ -lures.T
        bad -= base[noise]
        np.exp(bad, out=bad)
        bad += 1
        np.reciprocal(bad, out=bad)
        up = (good - 1) / len(rows)
        slope_hidden = up[:, None] * aims + bad @ (lures / len(rows))
        sums = _sums_by(at, slope_hidden, CONTEXT * (OUTPUTS + 1)).reshape(CONTEXT, OUTPUTS + 1, WIDTH)
        slopes = [np.einsum("kvd,vd->kd", sums, source), np.einsum("kvd,kd->vd", sums, place), _sums_by(goal[None, :], up[:, None] * hidden, OUTPUTS), np.bincount(goal, up, OUTPUTS).astype(np.float32)]
        np.add.at(slopes[2], noise, bad.T @ hidden / len(rows))
        np.add.at(slopes[3], noise, bad.sum(axis=0) / len(rows))
        for p, q, g in zip(parameters, squares, slopes, strict=True):
            q += g * g
            p -= (0.15 / (1 + epoch)) * g / np.sqrt(q)


def _untrained() -> list[np.ndarray]:
    return [np.zeros((CONTEXT, WIDTH), np.float32), np.zeros((OUTPUTS + 1, WIDTH), np.float32), np.zeros((OUTPUTS, WIDTH), np.float32), np.zeros(OUTPUTS, np.float32)]


def train(events: np.ndarray, sizes: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> list[np.ndarray]:
    """Place weights, source and sink vectors and biases from the events of one process."""
    if not len(events):
        return _untrained()
    rng = np.random.default_rng(seed)
    share = (np.bincount(events, minlength=OUTPUTS) + 1.0) / (len(events) + OUTPUTS)
    parameters, squares = begin_training(share, rng)
    before = contexts(events, sizes)
    for epoch in range(epochs):
        one_pass(parameters, squares, before, events, share, epoch, rng)
    return parameters


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float64)


def _unflat(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape).astype(np.float32) for part, a in zip(np.split(flat, ends[:-1]), like, strict=True)]


_SUMS = "n long, sums binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a task: events, and the sum of the arrays."""
    n, total = 0, None
    for batch in batches:
        for one, sums in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            n, total = n + one, np.frombuffer(sums) if total is None else total + np.frombuffer(sums)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def _learner(shared: Broadcast, share: np.ndarray, epoch: int, seed: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The pass over one part in one epoch: its events, and the parameters and Adagrad sums after it times the events."""

    def learn(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by([("at", "ascending"), ("ids", "ascending")])  # no order of arrival
        found = [np.frombuffer(i, np.int16).astype(np.int64) for i in own.column("ids").to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        events = np.concatenate(found)
        lead = np.repeat(own.column("lead").to_numpy(), sizes)
        goals = np.arange(len(events)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= lead  # the lead is context only
        p, q = ([a.copy() for a in arrays] for arrays in shared.value)
        one_pass(p, q, contexts(events, sizes).compress(goals, axis=1), events[goals], share, epoch, np.random.default_rng([seed, epoch, key[0].as_py()]))
        n = int(goals.sum())
        return pa.Table.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([(_flat(p + q) * n).tobytes()], pa.binary())})

    return learn


def train_all(pieces: DataFrame, event_counts: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> list[np.ndarray]:
    """Parameters from all pieces (part, at, lead, ids): each epoch averages one pass over every part."""
    if not event_counts.sum():
        return _untrained()
    share = (event_counts + 1.0) / (event_counts.sum() + OUTPUTS)
    parameters, squares = begin_training(share, np.random.default_rng(seed))
    for epoch in range(epochs):
        shared = pieces.sparkSession.sparkContext.broadcast((parameters, squares))
        sums = pieces.groupBy("part").applyInArrow(_learner(shared, share, epoch, seed), _SUMS).mapInArrow(_summed, _SUMS)
        rows = sums.repartition(8).mapInArrow(_summed, _SUMS).collect()  # at most eight rows
        mean = sum(np.frombuffer(r["sums"]) for r in rows) / sum(r["n"] for r in rows)
        both = _unflat(mean, parameters + squares)
        parameters, squares = both[: len(parameters)], both[len(parameters) :]
        shared.unpersist()
    return parameters


class _Numbers(dict):
    """Row of a known word in the model's table; other words give -1 less their group."""

    def __missing__(self, word: bytes) -> int:
        return -1 - group_of(word)


def event_log10(model: Model, events: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each event after its context, normalised over all events."""
    out = np.empty(len(events))
    before = contexts(events, sizes)
    scaled = [model.source * w for w in model.place]
    # no score lies beyond this, so that its exponential needs no scaling by the largest one of a row
    reach = sum(np.linalg.norm(s, axis=1).max() for s in scaled) * np.linalg.norm(model.sink, axis=1).max() + np.abs(model.bias).max()
    sink, one = np.ascontiguousarray(model.sink.T), np.ones(len(model.bias), np.float32)
    for begin in range(0, len(events), ROWS_AT_ONCE):
        ctx, goal = before[:, begin : begin + ROWS_AT_ONCE], events[begin : begin + ROWS_AT_ONCE]
        hidden = scaled[0].take(ctx[0], axis=0)
        for back in range(1, CONTEXT):
            hidden += scaled[back].take(ctx[back], axis=0)
        scores = hidden @ sink
        scores += model.bias
        right = scores[np.arange(len(goal)), goal].astype(float)
        if reach > 60:
            top = scores.max(axis=1)
            scores -= top[:, None]
            right -= top
        np.exp(scores, out=scores)
        out[begin : begin + ROWS_AT_ONCE] = (right - np.log((scores @ one).astype(float))) / np.log(10)
    return out


def fit(rows: DataFrame, text: str = "text", learned: str = "learned") -> tuple[Model, DataFrame]:
    """The model, and the stored word counts (word, c, total) over all rows."""
    counts = stored(count_words(rows, text, learned))
    common = counts.orderBy(F.desc("total"), "word").limit(KNOWN_WORDS)
    table = common.select("word", "c").toArrow()  # at most KNOWN_WORDS rows
    words, known = table.column("word").to_pylist(), table.column("c").to_pylist()
    heads = [w for w, c in sorted(zip(words, known, strict=True), key=lambda x: (-x[1], x[0])) if c > 0 and w != END][: OUTPUTS - GROUPS - 1]
    event = {w: GROUPS + 1 + i for i, w in enumerate(heads)} | {END: GROUPS}
    events = np.array([event[w] if w in event else group_of(w) for w in words], np.int64)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((GROUPS, 2), np.int64)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if c and word not in event:
                    sums[group_of(word)] += (c, 1)
        yield pa.RecordBatch.from_pydict({"g": np.arange(GROUPS), "n": sums[:, 0], "v": sums[:, 1]})

    total = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    sums = np.zeros((GROUPS, 2), np.int64)
    for r in counts.select("word", "c").mapInArrow(groups, "g long, n long, v long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sums[r["g"]] = r["n"], r["v"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", BATCH_BYTES):
            names, at, leads, found = [], [], [], []
            words, codes, sizes = coded(part.column("_text"))
            flat = np.array([event[w] if w in event else group_of(w) for w in words], np.int16)[codes]
            for ids, h in zip(np.split(flat, np.cumsum(sizes)[:-1]), part.column("_h").to_pylist(), strict=True):
                for begin in range(0, len(ids), PIECE):
                    lead = min(begin, CONTEXT)
                    names.append(h), at.append(begin), leads.append(lead)
                    found.append(ids[begin - lead : begin + PIECE].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at, pa.int64()), pa.array(leads, pa.int32()), pa.array(found, pa.binary())], ["_h", "at", "lead", "ids"])

    parts = max(1, -(-total["n"] // PART))
    # by id and text, so that copies of a text do not meet in one part
    named = rows.where(F.col(learned)).select(F.col(text).alias("_text"), F.xxhash64(*rows.columns).alias("_h"))
    pieces = named.mapInArrow(encode, "_h long, at long, lead int, ids binary")
    pieces = stored(pieces.select(F.pmod(F.xxhash64("_h", "at"), F.lit(parts)).alias("part"), F.xxhash64("_h", "at").alias("at"), "lead", "ids"))
    event_counts = np.zeros(OUTPUTS)
    event_counts[:GROUPS] = sums[:, 0]
    in_table = dict(zip(words, known, strict=True))
    event_counts[GROUPS + 1 : GROUPS + 1 + len(heads)] = [in_table[w] for w in heads]
    event_counts[GROUPS] = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    fitted = train_all(pieces, event_counts)
    return Model(words, events, np.array(known, np.int64), total["n"], total["v"], sums[:, 0], sums[:, 1], *fitted), counts


def score(rows: DataFrame, model: Model, counts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, then n_tokens, n_known, train_tokens, base_score, score for each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        numbers, inside = _Numbers(zip(model.words, range(len(model.words)), strict=True)), model.inside()
        counted, event_of = np.append(model.counts, 0), np.append(model.events, 0)
        weight = -np.log10(model.tokens + model.distinct + 1.0)
        number = TaskContext.get().partitionId() << 33
        for part in slices(batches, "_text", BATCH_BYTES):
            words, codes, sizes = coded(part.column("_text"))
            found = np.array([numbers[w] for w in words], np.int64)[codes]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rare: list[Counter] = [Counter() for _ in sizes]
            for at in np.flatnonzero(found < 0).tolist():
                rare[owner[at]][words[codes[at]]] += 1
            events = np.where(found < 0, -1 - found, event_of[found])
            c = np.where(found < 0, 0, counted[found])
            add_one = np.log10(c + 1.0)
            grouped = events < GROUPS
            value = event_log10(model, events, sizes)
            value[grouped] += inside[events[grouped]] + add_one[grouped]  # of the rest, the count comes by the join
            names = [n for n in part.schema.names if n != "_text"]
            total = lambda x: np.bincount(owner, x, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(number + np.arange(len(sizes)), pa.int64()), pa.array(sizes), pa.array(total(c > 0).astype(np.int64)), pa.array(total(add_one + weight)), pa.array(total(value)), pa.array([[{"word": w, "n": n} for w, n in own.items()] for own in rare], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                [*names, "_row", "n_tokens", "_known", "_base", "_score", "_rare"],
            )
            number += len(sizes)

    used = rows.select(*keep, F.col(text).alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in used.schema.fields[:-1])
    main = stored(used.mapInArrow(read, f"{kept}_row long, n_tokens long, _known long, _base double, _score double, _rare array<struct<word: binary, n: long>>"))
    # words beyond the broadcast table are rare, so no word is a hot key here
    looked_up = main.select("_row", F.explode("_rare").alias("_r")).select("_row", F.col("_r.word").alias("word"), "_r.n").join(counts.where("c > 0").select("word", "c"), "word")
    more = looked_up.groupBy("_row").agg(F.sum("n").alias("_k"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_m"))
    joined = main.drop("_rare").join(more, "_row", "left")
    extra = F.coalesce("_m", F.lit(0.0))
    return joined.select(
        *keep, "n_tokens", (F.col("_known") + F.coalesce("_k", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + extra).alias("base_score"), (F.col("_score") + extra).alias("score"),
    )
