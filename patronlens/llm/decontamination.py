"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of segments, each over the words of neighbouring documents: the
term list, the postings of every term (ascending word positions in the segment), and where
each document begins. Terms and postings are binary cells, which the JVM passes on as they are,
and `ROW_GROUP` segments are one row group, so that a reading task holds few at a time. A query phrase starts from the postings of its rarest term over the
whole corpus, shifted by the term's offset, and is intersected with the shifted postings of
the next rarer terms; positions within `slop` of their place give proximity matches.

A test item's windows are its runs of `window` words; an item of fewer words is one window.
Queries are cut into blocks of bounded size, each broadcast by itself, so the test set may
be large. No text or posting is shuffled: segments stay where their documents are.

Defined results: a null text has no words; a test item without words has no window; windows
that several items share count for each; a null item id counts for hits but is not listed;
repeated documents are reported one by one; empty tables give empty or clean results.
Documents of any length are held whole in one segment. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import slices, stored, words_in, words_of
from patronlens.llm.sieve import split_by

WINDOW = 10
SEGMENT_WORDS = 500_000
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
#: Segments of a Parquet row group; without it a task keeps at least a hundred of them before it looks at their size.
ROW_GROUP = 2
INTS, STRINGS = "array<int>", "array<string>"


def _lists(values: pa.Array | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list that holds all the values."""
    values = pa.array(values, kind) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _cell(data: bytes | pa.Buffer) -> pa.Array:
    """One binary cell, filled up to full eighths so that the next one begins at an even address."""
    data = pa.py_buffer(data)
    if data.size % 8:
        data = pa.py_buffer(data.to_pybytes() + bytes(-data.size % 8))
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], np.int32)), data])


def _packed_terms(terms: pa.Array, ends: np.ndarray) -> pa.Array:
    """The terms and where the postings of each end."""
    batch = pa.RecordBatch.from_arrays([terms, pa.array(ends, pa.int32())], ["term", "end"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return _cell(sink.getvalue())


def _terms(cell: pa.BinaryScalar) -> tuple[pa.Array, np.ndarray]:
    """The terms of a segment, and their postings' borders."""
    batch = pa.ipc.open_stream(cell.as_buffer()).read_next_batch()
    return batch.column("term"), np.concatenate([[0], batch.column("end").to_numpy()])


def _by_code(code: np.ndarray) -> np.ndarray:
    """Stable order of non-negative codes, by their lower and then their upper 16 bits."""
    order = np.argsort(code.astype(np.uint16), kind="stable")
    upper = (code >> 16).astype(np.uint16)
    return order[np.argsort(upper[order], kind="stable")] if upper.any() else order


def build_index(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Segments of the inverted index; the columns `keep` of the documents stay with them as lists."""
    used = documents.select(*keep, F.col(text).alias("_text"))

    def segment(number: int, held: list[tuple[list[pa.Array], pa.Array, np.ndarray]]) -> pa.RecordBatch:
        kept = [pa.concat_arrays(columns) for columns in zip(*(k for k, _, _ in held), strict=True)]
        sizes = np.concatenate([s for _, _, s in held])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # a gap after each document
        flat = pa.concat_arrays([w for _, w, _ in held]).dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False)
        place = np.arange(len(code)) + np.repeat(np.arange(len(sizes)), sizes)
        order = _by_code(code)
        ends = np.cumsum(np.bincount(code, minlength=len(flat.dictionary)))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *(_lists(k, k.type) for k in kept), _lists(begins, pa.int32()), _packed_terms(flat.dictionary, ends), _cell(place[order].astype(np.int32))],
            ["segment", *keep, "begins", "terms", "positions"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, words = TaskContext.get().partitionId() << 32, [], 0, 0
        for part in slices(batches, "_text", BATCH_BYTES):
            flat, sizes = words_in(part.column("_text"))
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()

            def take(begin: int, end: int, part=part, flat=flat, sizes=sizes, ends=ends) -> None:
                held.append(([part.column(k).slice(begin, end - begin) for k in keep], flat.slice(ends[begin], ends[end] - ends[begin]), sizes[begin:end]))

            begin = 0
            for row, own in enumerate(sizes.tolist()):
                if rows and words + own > SEGMENT_WORDS:
                    take(begin, row)
                    yield segment(number, held)
                    number, held, rows, words, begin = number + 1, [], 0, 0, row
                rows, words = rows + 1, words + own
            take(begin, len(sizes))
        if rows:
            yield segment(number, held)

    lists = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in used.schema.fields[:-1])
    return used.mapInArrow(build, f"segment long, {lists}, begins {INTS}, terms binary, positions binary")


def windows_of(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (array of words) with the sorted ids of the items that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = [], []
            for one, words in zip(batch.column("_item").to_pylist(), map(words_of, batch.column("_text").to_pylist()), strict=True):
                own = [words[i : i + window] for i in range(max(1, len(words) - window + 1))] if words else []
                ids += [one] * len(own)
                runs += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(runs, pa.list_(pa.string()))], ["item", "words"])

    used = items.select(F.col(item_id).cast("string").alias("_item"), F.col(text).alias("_text"))
    return used.mapInArrow(cut, f"item string, words {STRINGS}").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _blocks(windows: DataFrame) -> list[DataFrame]:
    """The windows in parts whose words and ids together stay near BLOCK_BYTES each."""
    size = windows.agg(F.sum(F.length(F.concat_ws(" ", "words")) + F.length(F.concat_ws(" ", "items")))).first()[0] or 0
    parts = int(size // BLOCK_BYTES) + 1
    if parts == 1:
        return [windows]
    return [windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part) for part in range(parts)]


def term_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Occurrences of each given term in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(terms, pa.string()), np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                held, ends = _terms(batch.column("terms")[row])
                at = pc.index_in(wanted, value_set=held)
                known = np.flatnonzero(at.is_valid())
                here = at.drop_null().to_numpy()
                total[known] += ends[here + 1] - ends[here]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    rows = index.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r["term"]]: r["n"] for r in rows}  # at most one row for each given term


def _phrase(lists: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Starts at which every list has a position at its offset; the shortest list comes first."""
    starts = lists[0] - offsets[0]
    for own, offset in zip(lists[1:], offsets[1:], strict=True):
        if not len(starts):
            break
        at = np.searchsorted(own, starts + offset)
        starts = starts[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == starts + offset)]
    return starts


def _near(lists: list[np.ndarray], offsets: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions around each position of the rarest term at which all terms lie within `slop` of their places."""
    starts = lists[0] - offsets[0]
    low = high = lists[0]
    for own, offset in zip(lists[1:], offsets[1:], strict=True):
        at = np.searchsorted(own, starts + offset)
        left, right = own[np.maximum(at - 1, 0)], own[np.minimum(at, len(own) - 1)]
        closest = np.where(np.abs(right - starts - offset) <= np.abs(left - starts - offset), right, left)
        good = np.abs(closest - starts - offset) <= slop
        starts, low, high = starts[good], np.minimum(low[good], closest[good]), np.maximum(high[good], closest[good])
    return low, high


def search(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Matches by segment and document ordinal: disjoint hit spans (first, end) and item ids.

    With slop 0 all exact occurrences are found. With a positive slop a match is a place of
    the window's rarest term around which each other term's nearest position is at most
    `slop` words from where the phrase would have it; the span covers all the terms.
    """
    found = []
    for block in _blocks(windows):
        queries = [(r["words"], r["items"]) for r in block.collect()]  # bounded by BLOCK_BYTES
        terms = sorted({w for words, _ in queries for w in words})
        counts = term_counts(index, terms)
        number = {t: i for i, t in enumerate(terms)}
        plans = []
        for words, items in queries:
            if all(w in counts for w in words):
                order = sorted(range(len(words)), key=lambda i, w=words: (counts[w[i]], i))
                plans.append(([number[words[i]] for i in order], order, items))
        asked = index.sparkSession.sparkContext.broadcast((terms, plans))

        def match(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            terms, plans = asked.value
            wanted = pa.array(terms, pa.string())
            for batch in batches:
                for row in range(batch.num_rows):
                    held, ends = _terms(batch.column("terms")[row])
                    here = pc.fill_null(pc.index_in(wanted, value_set=held), -1).to_numpy()
                    positions, begins = np.frombuffer(batch.column("positions")[row].as_buffer(), np.int32), batch.column("begins")[row].values.to_numpy()
                    firsts, lasts, owners = [], [], []
                    for at, (ids, offsets, _) in enumerate(plans):
                        known = here[ids]
                        if (known < 0).any():
                            continue
                        lists = [positions[ends[k] : ends[k + 1]] for k in known]
                        low, high = _near(lists, offsets, slop) if slop else ((s := _phrase(lists, offsets)), s + len(ids) - 1)
                        if len(low):
                            firsts.append(low)
                            lasts.append(high)
                            owners.append(np.full(len(low), at))
                    if not firsts:
                        continue
                    first, last, owner = map(np.concatenate, (firsts, lasts, owners))
                    document = np.searchsorted(begins, first, "right") - 1
                    inside = last < begins[document + 1]
                    first, last, owner, document = first[inside], last[inside], owner[inside], document[inside]
                    if not len(first):
                        continue
                    order = np.lexsort((first, document))
                    first, last, owner, document = first[order], last[order], owner[order], document[order]
                    cuts = np.flatnonzero(np.diff(document)) + 1
                    spans, items = [], []
                    for begin, end in zip([0, *cuts], [*cuts, len(document)], strict=True):
                        reach = np.maximum.accumulate(last[begin:end])
                        new = np.concatenate([[True], first[begin + 1 : end] > reach[:-1] + 1])
                        base = begins[document[begin]]
                        spans.append([{"first": int(a - base), "end": int(b - base + 1)} for a, b in zip(first[begin:end][new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [end - begin - 1]])], strict=True)])
                        items.append(sorted({i for k in set(owner[begin:end].tolist()) for i in plans[k][2]}))
                    yield pa.RecordBatch.from_pydict({
                        "segment": pa.array([batch.column("segment")[row].as_py()] * len(spans), pa.int64()),
                        "ordinal": pa.array(document[np.concatenate([[0], cuts])], pa.int32()),
                        "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                        "items": pa.array(items, pa.list_(pa.string())),
                    })

        columns = index.select("segment", "begins", "terms", "positions")
        found.append(columns.mapInArrow(match, f"segment long, ordinal int, spans array<struct<first: int, end: int>>, items {STRINGS}"))
    # one row for each document and block, so the lists below hold at most one entry a block
    return reduce(DataFrame.union, found).groupBy("segment", "ordinal").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )


def contamination(documents: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, slop: int = 0, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For every document: `keep`, n_words, n_hit (words inside matches), items (their ids), contaminated."""
    index = stored(build_index(documents, keep, text), options={"parquet.block.row.count.limit": str(ROW_GROUP), "parquet.page.size.row.check.min": "1"})
    matches = search(index, stored(windows_of(items, window, item_id, item_text)), slop)
    rows = index.select("segment", "begins", F.posexplode(F.arrays_zip(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keep)])).alias("ordinal", "_kept")).select(
        "segment", "ordinal", (F.element_at("begins", F.col("ordinal") + 2) - F.element_at("begins", F.col("ordinal") + 1) - 1).cast("long").alias("_n"), "_kept"
    )
    empty = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", empty, lambda held, span: F.struct(
        F.greatest(held["reach"], span["end"]).alias("reach"), (held["n"] + F.greatest(span["end"] - F.greatest(held["reach"], span["first"]), F.lit(0))).alias("n"),
    ))["n"]
    joined = rows.join(matches, ["segment", "ordinal"], "left")
    n_hit = F.coalesce(covered, F.lit(0).cast("long"))
    return joined.select(
        *[F.col(f"_kept.{_zipped(i)}").alias(k) for i, k in enumerate(keep)], F.col("_n").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast(STRINGS)).alias("items"), (n_hit > 0).alias("contaminated"),
    )


def _zipped(position: int) -> str:
    return f"_{position}"


def clean_documents(documents: DataFrame, items: DataFrame, window: int = WINDOW, document_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without those that hold a window of a test item."""
    keyed = documents.select(F.col(document_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("_text"))
    bad = stored(contamination(keyed, items, ["id", "th"], window, text="_text").where("contaminated").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct())
    names = [f"_c{i}" for i in range(len(documents.columns))]
    rows = documents.select(*[F.col(c).alias(n) for c, n in zip(documents.columns, names, strict=True)], F.col(document_id).alias("_own"), F.xxhash64(text).alias("th"))
    maybe, clear = split_by(rows, "th", bad.select(F.col("_th").alias("th")))
    kept = maybe.join(bad, (F.col("th") == F.col("_th")) & F.col("_own").eqNullSafe(F.col("_id")), "left_anti").select(*names).union(clear.select(*names))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(documents.columns, names, strict=True)])
