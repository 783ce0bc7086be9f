"""Token files: ids in blocks, each coded by an adaptive context-mixing range coder.

A block holds whole documents and is reset and checksummed by itself. Its ids are dealt to
lanes, which are neighbouring stretches of the block with a range coder each; one model
serves all lanes, and step t codes the t-th id of every lane at once, so all work is array
operations and the decoder repeats them in the same order.

The model predicts an id from the two ids before it (order 2), the one before it (order 1)
and its frequency so far (order 0). One decision says whether the order-2 guess, the order-1
guess or neither holds; its probabilities are mixed from three adaptive tables, by the
confidence of either guess and overall, with weights that follow how well each table did.
An id that no guess names is coded by its order-0 frequency. Only integers take part in the
coding, so every machine gives the same bits.

A file is one part of the stored block table, in ascending order of the document id (null
ids first, equal ids by text hash). Row: file, block, before (ids ahead of it in the file),
the kept columns and sizes of its documents, payload.

Payload, little-endian: magic b"PLT1"; u32 ids, lanes, vocabulary, crc32 of the ids as
unsigned 32-bit; u32 words of each lane; the lanes' 16-bit words.

Defined results: a null text is empty and holds the end id alone; repeated rows are kept one
by one; an empty table has no block. A block that does not give its checksum is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm.common import slices, stored
from patronlens.llm.tokens import END, default_path, encoder

MAGIC = b"PLT1"
BLOCK_IDS = 1 << 20
LANES = 8192
SHORTEST_LANE = 64
HASH_BITS = 18
BATCH_BYTES = 4 << 20
#: Next confidence of a guess by (missed or hit) * 8 + confidence.
_SURER = np.array([0, 0, 0, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6, 7, 7], np.int8)
_TOP, _WINDOW = np.uint64(1 << 32), np.uint64((1 << 48) - 1)


class _Model:
    """Adaptive state of a block; the same calls in the same order on both sides."""

    def __init__(self, vocabulary: int, lanes: int):
        self.counts, self.total = np.ones(vocabulary, np.int64), vocabulary
        self.sums = np.zeros(vocabulary + 1, np.int64)
        self.step = max(1, (1 << 21) // max(lanes, 1) // 16)
        self.guess = [np.zeros(vocabulary, np.int32), np.zeros(1 << HASH_BITS, np.int32)]
        self.sure = [np.zeros(vocabulary, np.int8), np.zeros(1 << HASH_BITS, np.int8)]
        self.tables = [np.full((16, 3), 32, np.int64), np.full((8, 3), 32, np.int64), np.full((1, 3), 32, np.int64)]
        self.weights = np.array([86, 85, 85], np.int64)
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        """Guesses of both orders for the first n lanes and the frequencies of the three outcomes."""
        one = self.one[:n]
        self.spot = ((self.two[:n] * 0x9E3779B1 + one * 0x85EBCA77) >> 7) & ((1 << HASH_BITS) - 1)
        self.first, self.second = self.guess[0].take(one), self.guess[1].take(self.spot)
        self.sure1, self.sure2 = self.sure[0].take(one), self.sure[1].take(self.spot)
        # one key for the confidence of order 1, whether the guesses agree, and the confidence of order 2
        self.key = (((self.sure1 << 1) | (self.first == self.second)).astype(np.int64) << 3) | self.sure2
        self.shares = [(t << 16) // t.sum(axis=1, keepdims=True) for t in self.tables]
        one_, two_, all_ = ((w * s) >> 8 for w, s in zip(self.weights, self.shares, strict=True))
        mixed = np.maximum((one_ + all_)[:, None, :] + two_[None, :, :], 32).reshape(8, 2, 8, 3)
        mixed[:, 1, :, 2] += mixed[:, 1, :, 1]
        mixed[:, 1, :, 1] = 0
        self.first_share, self.second_share = mixed[..., 1].ravel().take(self.key), mixed[..., 2].ravel().take(self.key)

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        n = len(ids)
        seen = np.bincount(self.key * 3 + outcome, minlength=384).reshape(16, 8, 3)
        gains = []
        for table, share, own in zip(self.tables, self.shares, (seen.sum(axis=1), seen.sum(axis=0), seen.sum(axis=(0, 1))[None, :]), strict=True):
            gains.append(int((own * share).sum()))
            table += own
            full = table.sum(axis=1) > 1 << 20
            if full.any():
                table[full] = (table[full] >> 1) + 1
        total = sum(gains)
        self.weights = np.maximum((3 * self.weights + np.array([256 * g // total for g in gains])) >> 2, 8)
        self.weights[0] += 256 - int(self.weights.sum())
        for order, (at, guess, sure) in enumerate(((self.one[:n], self.first, self.sure1), (self.spot, self.second, self.sure2))):
            hit = guess == ids
            self.sure[order][at] = _SURER.take((hit.view(np.int8) << 3) | sure)
            self.guess[order][at] = np.where(hit | (sure > 1), guess, ids)
        np.add.at(self.counts, ids, self.step)
        self.total += n * self.step
        if self.total > 1 << 22:
            self.counts = (self.counts >> 1) + 1
            self.total = int(self.counts.sum())
        self.two[:n] = self.one[:n]
        self.one[:n] = ids

    def frequencies(self) -> np.ndarray:
        """Cumulative order-0 counts, with the total at the end; until the next call."""
        np.cumsum(self.counts, out=self.sums[1:])
        return self.sums.view(np.uint64)


def _divided(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a // b for a below 2^52, where the quotient as a double never reaches the next whole number."""
    return (a / b).astype(np.uint64)


def _places(sums: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The last place of each value in the rising sums; sorted values meet neighbouring memory."""
    bits = max(len(values) - 1, 1).bit_length()
    packed = np.sort((values << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64))
    out = np.empty(len(values), np.int64)
    out[(packed & np.uint64((1 << bits) - 1)).astype(np.int64)] = np.searchsorted(sums, packed >> np.uint64(bits), "right") - 1
    return out


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids."""
    lanes = max(1, min(LANES, n // SHORTEST_LANE))
    steps = -(-n // lanes)
    return -(-n // steps) if n else 1, steps


class _Writer:
    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
        self.out, self.at = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray | slice, begin: np.ndarray, size: np.ndarray, total: int | None) -> None:
        """Narrow the ranges of the lanes to [begin, begin + size) of the total (None: 2^16)."""
        low, span = self.low[lanes], self.range[lanes]
        part = span >> np.uint64(16) if total is None else _divided(span, total)
        low = low + part * begin
        span = part * size
        which = np.arange(len(self.low))[lanes]
        over = np.flatnonzero(low > _WINDOW)
        if len(over):  # carry into words that are already out
            low[over] &= _WINDOW
            rows, back = which[over], 1
            while len(rows):
                spot = self.at[rows] - back
                self.out[rows, spot] += np.uint16(1)
                rows, back = rows[self.out[rows, spot] == 0], back + 1
        short = np.flatnonzero(span < _TOP)
        if len(short):
            rows = which[short]
            self.out[rows, self.at[rows]] = low[short] >> np.uint64(32)
            self.at[rows] += 1
            low[short] = (low[short] << np.uint64(16)) & _WINDOW
            span[short] <<= np.uint64(16)
        self.low[lanes], self.range[lanes] = low, span

    def close(self) -> list[np.ndarray]:
        """Words of each lane; a decoder reads zeros beyond them."""
        for shift in (32, 16, 0):
            self.out[np.arange(len(self.at)), self.at] = (self.low >> np.uint64(shift)) & np.uint64(0xFFFF)
            self.at += 1
        return [row[:n] for row, n in zip(self.out, self.at, strict=True)]


def encode_block(ids: np.ndarray) -> bytes:
    """Payload of the ids (at least one)."""
    ids = np.ascontiguousarray(ids, np.int64)
    n, vocabulary = len(ids), int(ids.max()) + 1
    lanes, steps = _lanes(n)
    model, writer = _Model(vocabulary, lanes), _Writer(lanes, 3 * steps + 4)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps
    for step in range(steps):
        live = lanes if step < last else lanes - 1
        own = grid[step, :live]
        model.predict(live)
        by_second = model.second == own
        by_first = (model.first == own) & ~by_second
        outcome = np.where(by_second, 2, by_first.astype(np.int64))
        s2, s1 = model.second_share, model.first_share
        begin = np.where(by_second, 0, np.where(by_first, s2, s2 + s1))
        size = np.where(by_second, s2, np.where(by_first, s1, 65536 - s2 - s1))
        writer.put(slice(0, live), begin.astype(np.uint64), size.astype(np.uint64), None)
        rest = np.flatnonzero(outcome == 0)
        if len(rest):
            sums, left = model.frequencies(), own[rest]
            writer.put(rest, sums[left], sums[left + 1] - sums[left], int(sums[-1]))
        model.learn(own, outcome)
    words = writer.close()
    head = struct.pack("<4sIIII", MAGIC, n, lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + np.array([len(w) for w in words], "<u4").tobytes() + np.concatenate(words).astype("<u2").tobytes()


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of a payload, checked against its checksum."""
    magic, n, lanes, vocabulary, crc = struct.unpack_from("<4sIIII", payload)
    if magic != MAGIC or (lanes, -(-n // lanes)) != _lanes(n):
        raise ValueError("not a token block")
    sizes = np.frombuffer(payload, "<u4", lanes, 20).astype(np.int64)
    stream = np.concatenate([np.frombuffer(payload, "<u2", int(sizes.sum()), 20 + 4 * lanes), np.zeros(4, "<u2")]).astype(np.uint64)
    at, steps = np.cumsum(sizes) - sizes, -(-n // lanes)
    code = (stream[at] << np.uint64(32)) | (stream[at + 1] << np.uint64(16)) | stream[at + 2]
    at, span = at + 3, np.full(lanes, 1 << 48, np.uint64)
    model, grid = _Model(vocabulary, lanes), np.zeros((steps, lanes), np.int64)
    last = n - (lanes - 1) * steps

    def narrow(lanes_: np.ndarray | slice, part: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        value, width, place = code[lanes_] - part * begin, part * size, at[lanes_]
        short = np.flatnonzero(width < _TOP)
        value[short] = (value[short] << np.uint64(16)) | stream[np.minimum(place[short], len(stream) - 1)]
        width[short] <<= np.uint64(16)
        place[short] += 1
        code[lanes_], span[lanes_], at[lanes_] = value, width, place

    for step in range(steps):
        live = lanes if step < last else lanes - 1
        model.predict(live)
        s2, s1 = model.second_share, model.first_share
        part = span[:live] >> np.uint64(16)
        value = np.minimum(_divided(code[:live], part), np.uint64(65535)).astype(np.int64)
        outcome = np.where(value < s2, 2, (value < s2 + s1).astype(np.int64))
        begin = np.where(outcome == 2, 0, np.where(outcome == 1, s2, s2 + s1))
        size = np.where(outcome == 2, s2, np.where(outcome == 1, s1, 65536 - s2 - s1))
        narrow(slice(0, live), part, begin.astype(np.uint64), size.astype(np.uint64))
        own = np.where(outcome == 2, model.second, model.first).astype(np.int64)
        rest = np.flatnonzero(outcome == 0)
        if len(rest):
            sums = model.frequencies()
            part = _divided(span[rest], model.total)
            value = np.minimum(_divided(code[rest], part), sums[-1] - np.uint64(1))
            left = _places(sums, value)
            narrow(rest, part, sums[left], sums[left + 1] - sums[left])
            own[rest] = left
        grid[step, :live] = own
        model.learn(own, outcome)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a token block does not give its checksum")
    return ids


def write_files(documents: DataFrame, document_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The stored block table: file, block, before, ids (document ids), sizes, payload."""
    path = tokenizer or default_path()
    used = documents.select(F.col(document_id).alias("_id"), F.col(text).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    ranged = used.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, block, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = [len(i) for i in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([encode_block(np.concatenate(ids))], pa.binary())],
                ["file", "block", "before", "ids", "sizes", "payload"],
            )

        for part in slices(batches, "_text", BATCH_BYTES):
            kind = part.schema.field("_id").type
            for name, own in zip(part.column("_id").to_pylist(), encode.closed(part.column("_text").to_pylist(), END), strict=True):
                if ids and held + len(own) > BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + held
                    names, ids, held = [], [], 0
                names.append(name)
                ids.append(own)
                held += len(own)
        if ids:
            yield flush()

    return stored(ranged.mapInArrow(pack, f"file int, block int, before long, ids array<{used.schema['_id'].dataType.simpleString()}>, sizes array<int>, payload binary"))


def read_files(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of a block table: id, start, n_tokens, ids_crc32 (and tokens), in no order."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = decode_block(batch.column("payload")[row].as_py())
                sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
                ends = np.cumsum(sizes)
                own = [ids[b:e] for b, e in zip(ends - sizes, ends, strict=True)]
                columns = {
                    "file": pa.array([batch.column("file")[row].as_py()] * len(own), pa.int32()), "id": batch.column("ids")[row].values, "_start": pa.array(batch.column("before")[row].as_py() + ends - sizes),
                    "n_tokens": pa.array(sizes), "ids_crc32": pa.array([zlib.crc32(o.astype("<u4").tobytes()) for o in own], pa.int64()),
                }
                if with_ids:
                    columns["tokens"] = pa.array([o.astype(np.int32) for o in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    rows = blocks.select("file", "before", "ids", "sizes", "payload").mapInArrow(unpack, f"file int, id {kind}, _start long, n_tokens long, ids_crc32 long{', tokens array<int>' if with_ids else ''}")
    # one row a file: the ids of all files before it
    totals = blocks.select("file", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    ahead = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("_ahead"))
    joined = rows.join(ahead, "file")
    return joined.select("id", (F.col("_start") + F.col("_ahead")).alias("start"), "n_tokens", "ids_crc32", *(["tokens"] if with_ids else []))
