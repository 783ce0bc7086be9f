"""Sequence packing as vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. An
open sequence takes, of all waiting examples that fit, the one whose demand has the largest
dot product with what is left, both as shares of the limits. Where none fits and room is
left, the example of the largest product is cut to fill the room. What is left at the end
of a buffer goes to sequences of power-of-two length, which need no padding.

Each task packs its own documents in buffers of about `BUFFER_TOKENS` tokens, so nothing is
shuffled and memory is bounded; a sequence's id is made of the task's number and a count,
so a repeated task gives the same rows.

Defined results: a null text is empty and holds the end id alone; documents longer than a
sequence are cut; repeated rows are packed one by one. With `prompt`, the ids of that column
come first and bear no loss (a null prompt is empty). Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import slices
from patronlens.llm.tokens import END, default_path, encoder

TOKENS = 2048
SEGMENTS = 256
BUFFER_TOKENS = 1 << 20
BATCH_BYTES = 1 << 20

#: (document, start, length, sequence, offset)
Piece = tuple[int, int, int, int, int]


def pack(lengths: np.ndarray, free: np.ndarray, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None) -> list[Piece]:
    """Pieces of documents of the given lengths, of which the first `free` tokens bear no loss."""
    limit = np.array([tokens, loss or tokens], float)
    start, length = np.zeros(len(lengths), np.int64), lengths.astype(np.int64).copy()
    out: list[Piece] = []
    sequence = 0

    def reach(room: int, bearing: int, which) -> np.ndarray:
        """How many tokens of each waiting example fit."""
        plain = np.maximum(free[which] - start[which], 0)
        return np.minimum(np.minimum(length[which], room), plain + bearing)

    def fill(size: int, most: int) -> bool:
        """One sequence of at most `size` tokens; False when nothing waits."""
        nonlocal sequence
        waiting = np.flatnonzero(length > 0)
        if not len(waiting):
            return False
        bears = length[waiting] - np.clip(free[waiting] - start[waiting], 0, length[waiting])
        demand = np.stack([length[waiting], bears], axis=1) / limit
        room, bearing, used, offset = size, min(int(limit[1]), size), 0, 0
        open_ = np.ones(len(waiting), bool)
        while room and used < most and open_.any():
            product = demand @ (np.array([room, bearing]) / limit)
            fits = open_ & (length[waiting] <= room) & (bears <= bearing)
            whole = bool(fits.any())
            pick = int(np.argmax(np.where(fits if whole else open_, product, -1.0)))
            at = waiting[pick]
            take = int(reach(room, bearing, at))
            open_[pick] = False
            if take <= 0:
                continue
            out.append((int(at), int(start[at]), take, sequence, offset))
            bearing -= take - int(np.clip(free[at] - start[at], 0, take))
            start[at] += take
            length[at] -= take
            room, offset, used = room - take, offset + take, used + 1
        sequence += 1
        return True

    for at in np.flatnonzero(lengths > tokens):  # full sequences of one document need no search
        while length[at] >= tokens and (take := int(reach(tokens, int(limit[1]), at))) == tokens:
            out.append((int(at), int(start[at]), take, sequence, 0))
            start[at] += take
            length[at] -= take
            sequence += 1
    while (left := int(length.sum())) >= tokens:
        fill(tokens, segments)
    while (left := int(length.sum())) > 0:
        fill(1 << (left.bit_length() - 1), segments)
    return out


def packed(documents: DataFrame, keep: list[str], text: str = "text", prompt: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """`keep`, then start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for each piece."""
    path = tokenizer or default_path()
    used = documents.select(*keep, (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("_prompt"), F.col(text).alias("_text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(path), TaskContext.get().partitionId() << 36
        parts, ids, free, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            found = pack(np.fromiter(map(len, ids), np.int64, len(ids)), np.array(free, np.int64), tokens, segments, loss)
            rows, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*found, strict=True))
            cut = [ids[r][s : s + n].astype("<u4") for r, s, n, _, _ in found]
            kept = pa.Table.from_batches(parts).take(pa.array(rows)).combine_chunks()
            columns = {c: kept.column(c).combine_chunks() for c in keep}
            columns |= {"start": start, "length": length, "ids_crc32": np.array([zlib.crc32(c.tobytes()) for c in cut], np.int64)}
            columns |= {"doc_tokens": np.array([len(i) for i in ids], np.int64)[rows], "sequence_id": base + sequence, "offset": offset}
            if with_ids:
                columns["ids"] = pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32()))
            base += int(sequence.max()) + 1
            return pa.RecordBatch.from_pydict(columns)

        for part in slices(batches, "_text", BATCH_BYTES):
            first = encode(part.column("_prompt").to_pylist()) if prompt else [np.zeros(0, np.int32)] * part.num_rows
            both = [np.concatenate([a, b]) if len(a) else b for a, b in zip(first, encode.closed(part.column("_text").to_pylist(), END), strict=True)]
            parts.append(part.select(keep) if keep else part.select(["_prompt"]))
            ids += both
            free += map(len, first)
            held += sum(map(len, both))
            if held >= BUFFER_TOKENS:
                yield flush()
                parts, ids, free, held = [], [], [], 0
        if ids:
            yield flush()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[: len(keep)])
    schema = f"{kept}{', ' if kept else ''}start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{', ids array<int>' if with_ids else ''}"
    return used.mapInArrow(place, schema)
