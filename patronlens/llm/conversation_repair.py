"""Repair of the turn structure of conversations: the cheapest edits that give a legal order of roles.

Legal is `(s?(ua)+)?` over the initials of the roles. Edits and costs: Keep 0, Rerole to user or
assistant 1, Delete 2 (required for blank rows and duplicates), Insert an empty turn 5; a
truncated row that stays adds 5. Of all cheapest edits those with the ASCII-least initials
are taken.

After every prefix of the rows only the state matters: nothing, `s`, `u` or `a` emitted last.
The dynamic programme runs backward over cost-to-go vectors of these four states and is
square-root checkpointed. The rows of a conversation are cut into blocks that grow with the
square root of their position, so n rows make about sqrt(n) blocks of at most about sqrt(n)
rows, and no length need be known. Each block is summed up as the cheapest way from each state
to each other; a conversation's chain of summaries, walked backward, gives the vectors at the
block borders, and these checkpoints are all that is stored. Going forward, each block computes
its own vectors again from its checkpoint and emits the tight edits, once for each state it could
be entered in; the chain of blocks then says which one is meant. So a task holds a block or the
chain of a conversation, never a conversation, and blocks of one conversation run in parallel.

Equal rows are counted before the first shuffle, positions come from `ordering.ranked`, and
duplicates are found as the first position of each (role, text digest), merged on the map side.

Defined results: rows go by turn (nulls first), then role, then text; a null role or text is
one space; a null conversation id is a conversation of its own; the first fault of a row counts
(blank, duplicate, truncated); repeated rows are duplicates; an empty table has no conversation.
Turns of any length are kept whole, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from patronlens.llm.common import stored
from patronlens.llm.ordering import ranked

#: Block k holds the rows from BLOCK * k**2 up to BLOCK * (k + 1)**2.
BLOCK = 256
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
#: States: nothing emitted yet, after s, after u, after a. The turn that an inserted or re-roled row gives in each.
STATES = range(4)
_TURN = ("u", "u", "a", "u")
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FORCED = tuple(_NEXT[q, _TURN[q]] for q in STATES)
LEGAL = ("su", "ua", "au")

#: Initial of the role, fault (0 none, 1 truncated, 2 to be deleted), copies.
ROW = tuple[str, int, int]
#: Kinds of first faults.
BLANK, DUPLICATE, TRUNCATION = 1, 2, 3


def _with_inserts(own: list[int]) -> list[int]:
    """Cost-to-go where turns may be inserted first: two at most, as the third would be back in the same state."""
    once = [INSERT + own[_FORCED[q]] for q in STATES]
    return [min(own[q], once[q], INSERT + once[_FORCED[q]]) for q in STATES]


def _before(row: ROW, after: list[int]) -> list[int]:
    """Cost-to-go before a row from that after it. Copies beyond the first are duplicates."""
    initial, fault, copies = row
    out = [DELETE + after[q] for q in STATES]
    if fault < 2:
        stay = TRUNCATED * fault
        for q in STATES:
            kept = _NEXT.get((q, initial))
            out[q] = min(out[q], stay + REROLE + after[_FORCED[q]], stay + after[kept] if kept is not None else NEVER)
    out = [c + DELETE * (copies - 1) for c in out]
    return _with_inserts(out)


def _last() -> list[int]:
    """Cost-to-go after the last row: only a full exchange, or nothing at all, may end."""
    return _with_inserts([0, NEVER, NEVER, 0])


def _backward(rows: list[ROW], after: list[int]) -> list[list[int]]:
    found = [after]
    for row in reversed(rows):
        found.append(_before(row, found[-1]))
    return found[::-1]


def _summary(rows: list[ROW]) -> list[int]:
    """Cheapest way through a block from each state to each other, inserts before its rows included; 16 numbers."""
    ends = [_backward(rows, [0 if q == end else NEVER for q in STATES])[0] for end in STATES]
    return [min(ends[end][q], NEVER) for q in STATES for end in STATES]


def _walk(rows: list[ROW], vectors: list[list[int]], state: int, last: bool) -> tuple[list[str], list[str], int]:
    """Tight edits from a state, ASCII-least: for every row its letters and the turns they emit, and the state after all.

    A turn is `u` or `a` for an inserted one, `U` or `A` for a re-roled row and `=` for the row as
    it is. After the last block, the closing inserts are one more entry.
    """
    letters, turns = [], []
    for row, now, after in zip(rows, vectors, vectors[1:], strict=False):
        initial, fault, copies = row
        extra = DELETE * (copies - 1)
        own, emitted = "", ""
        left = now[state]
        while True:
            stay = extra + TRUNCATED * fault
            kept = _NEXT.get((state, initial))
            if left == extra + DELETE + after[state]:
                own += "D"
            elif left == INSERT + now[_FORCED[state]]:
                own, emitted = own + "I", emitted + _TURN[state]
                state = _FORCED[state]
                left = now[state]
                continue
            elif fault < 2 and kept is not None and left == stay + after[kept]:
                own, emitted, state = own + "K", emitted + "=", kept
            else:
                own, emitted, state = own + "R", emitted + _TURN[state].upper(), _FORCED[state]
            break
        letters.append(own + "D" * (copies - 1))
        turns.append(emitted)
    if last:
        own = ""
        while state in (1, 2):
            own, state = own + _TURN[state], _FORCED[state]
        letters.append("I" * len(own))
        turns.append(own)
    return letters, turns, state


def _block(idx: Column) -> Column:
    """floor(sqrt(idx / BLOCK)), exact in long arithmetic."""
    guess = F.floor(F.sqrt(idx / BLOCK)).cast("long")
    return guess - F.when(guess * guess * BLOCK > idx, 1).otherwise(0) + F.when((guess + 1) * (guess + 1) * BLOCK <= idx, 1).otherwise(0)


def _mapped(frame: DataFrame, function, schema: str) -> DataFrame:
    """One result row a row, or several, made by a Python function of the row's values as a dictionary."""
    schema = schema.format(id=frame.schema["conv_id"].dataType.simpleString())
    kind = frame.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                out = [made for row in batch.slice(begin, 1024).to_pylist() for made in function(row)]
                yield pa.RecordBatch.from_pylist(out, arrow)

    return frame.mapInArrow(run, kind)


@dataclass
class Repair:
    """`conversations`: one row a conversation (counters, cost, audit); `turns`: the repaired turns in order."""

    conversations: DataFrame
    turns: DataFrame


def _rows(own: list[dict]) -> list[ROW]:
    return [(r["initial"], {0: 0, TRUNCATION: 1}.get(r["kind"], 2), r["copies"]) for r in own]


def _block_summary(row: dict) -> Iterator[dict]:
    own = row["rows"]
    initials, seen, copies = [r["initial"] for r in own], [r["turn"] for r in own if r["turn"] is not None], sum(r["copies"] for r in own)
    blank = sum(r["copies"] for r in own if r["kind"] == BLANK)
    first = sum(r["kind"] not in (BLANK, DUPLICATE) for r in own)
    yield {
        "conv_id": row["conv_id"], "block": row["block"], "ways": _summary(_rows(own)),
        "blank": blank, "duplicate": copies - blank - first, "truncated": sum(r["kind"] == TRUNCATION for r in own),
        # copies stand side by side and never are a legal pair
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + copies - len(own),
        "low": min(seen, default=None), "high": max(seen, default=None), "places": len(set(seen)), "first": initials[0], "last": initials[-1],
    }


_SUMMARY = "conv_id {id}, block long, ways array<long>, blank long, duplicate long, truncated long, illegal long, low long, high long, places long, first string, last string"


def _checkpoints(row: dict) -> Iterator[dict]:
    """The chain of a conversation's blocks, backward: the cost-to-go vector after each block."""
    chain, vector = row["chain"], _last()
    vectors = []
    for own in reversed(chain):
        vectors.append(vector)
        ways = own["ways"]
        vector = [min(ways[4 * q + end] + vector[end] for end in STATES) for q in STATES]
    for number, (own, after) in enumerate(zip(chain, reversed(vectors), strict=True)):
        before = chain[number - 1] if number else None
        joint = 0 if before is None else (before["last"] + own["first"] not in LEGAL)
        # turns ascend, so a block repeats a turn of the one before only at their border
        places = own["places"] - (before is not None and before["high"] is not None and before["high"] == own["low"])
        yield {
            "conv_id": row["conv_id"], "block": own["block"], "after": after, "final": number == len(chain) - 1, "cost": vector[0] if number == 0 else 0,
            "blank": own["blank"], "duplicate": own["duplicate"], "truncated": own["truncated"], "illegal": own["illegal"] + joint,
            "low": own["low"], "high": own["high"], "places": places,
        }


_CHECKPOINT = "conv_id {id}, block long, after array<long>, final boolean, cost long, blank long, duplicate long, truncated long, illegal long, low long, high long, places long"


def _walks(row: dict) -> Iterator[dict]:
    """A block's vectors, made again from its checkpoint, and its edits from each state it may be entered in."""
    rows = _rows(row["rows"])
    vectors = _backward(rows, row["after"])
    out = []
    for state in STATES:
        letters, turns, end = _walk(rows, vectors, state, row["final"])
        out.append({"state": state, "end": end, "letters": letters, "turns": turns})
    yield {"conv_id": row["conv_id"], "block": row["block"], "walks": out}


_WALK = "conv_id {id}, block long, walks array<struct<state: int, end: int, letters: array<string>, turns: array<string>>>"


def _entries(row: dict) -> Iterator[dict]:
    """The chain of blocks, forward: the state in which each is entered."""
    state = 0
    for own in row["chain"]:
        yield {"conv_id": row["conv_id"], "block": own["block"], "entered": state}
        state = next(w["end"] for w in own["walks"] if w["state"] == state)


def _chained(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("chain"))


def _same_block(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    return a.join(other, (F.col("block") == F.col("_block")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "_block")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> Repair:
    """Rows with conv_id, turn, role and text; `ids` adds conversations that have no row."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    kind = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATION)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    placed = ranked(own.withColumns({"kind": kind, "name": F.unhex(F.sha2("text", 256))}), ["conv_id"], ["turn", "role", "text"])
    placed = placed.withColumnRenamed("_idx", "idx")

    first = placed.groupBy("conv_id", "role", "name").agg(F.min("idx").alias("_at")).select(F.col("conv_id").alias("_conv"), "_at")
    told = placed.drop("text", "name").join(first, (F.col("idx") == F.col("_at")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    kind = F.when((F.col("kind") != BLANK) & F.col("_at").isNull(), DUPLICATE).otherwise(F.col("kind"))
    row = F.struct("idx", "turn", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), "copies")
    blocks = stored(told.groupBy("conv_id", _block(F.col("idx")).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows")))

    sums = _mapped(blocks, _block_summary, _SUMMARY)
    points = stored(_mapped(_chained(sums, *sums.columns[2:]), _checkpoints, _CHECKPOINT))
    walks = stored(_mapped(_same_block(blocks, points.select("conv_id", "block", "after", "final")), _walks, _WALK))
    ends = walks.select("conv_id", "block", F.transform("walks", lambda w: F.struct(w["state"].alias("state"), w["end"].alias("end"))).alias("walks"))
    entries = _mapped(_chained(ends, "walks"), _entries, "conv_id {id}, block long, entered int")
    walk = F.filter("walks", lambda w: w["state"] == F.col("entered"))[0]
    meant = stored(_same_block(walks, entries).select("conv_id", "block", walk["letters"].alias("letters"), walk["turns"].alias("turns")))

    counters = ["cost", "blank", "duplicate", "truncated", "illegal", "places"]
    parts = points.select("conv_id", *counters, "low", "high").unionByName(
        meant.select("conv_id", F.struct("block", F.array_join("letters", "").alias("letters")).alias("audit")), allowMissingColumns=True
    )
    if ids is not None:
        parts = parts.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    found = parts.groupBy("conv_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters], F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_join(F.transform(F.sort_array(F.collect_list("audit")), lambda a: a["letters"]), "").alias("audit"),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("places"), F.lit(0)).cast("long").alias("gaps")
    conversations = found.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    given = meant.select("conv_id", "block", F.posexplode("turns").alias("_j", "codes")).where("codes != ''")
    given = given.select(F.col("conv_id").alias("_conv"), (F.col("block") * F.col("block") * BLOCK + F.col("_j")).alias("_at"), "codes")
    texts = placed.select("conv_id", "idx", "role", "text")
    lines = given.join(texts, (F.col("idx") == F.col("_at")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    code = F.transform(F.sequence(F.lit(1), F.length("codes")), lambda i: F.substring(F.col("codes"), i, F.lit(1)))
    lines = lines.select(F.col("_conv").alias("conv_id"), F.col("_at").alias("position"), "role", "text", F.posexplode(code).alias("part", "code"))
    role = F.when(F.col("code") == "=", F.col("role")).when(F.lower("code") == "u", "user").otherwise("assistant")
    text = F.when(F.col("code").isin("=", "U", "A"), F.col("text")).otherwise("")
    return Repair(conversations, lines.select("conv_id", "position", "part", role.alias("role"), text.alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of every conversation's repaired `role:text`, newline-joined, as its turns stream by in order.

    One digest of a whole conversation cannot be computed in parts, so here all turns of a
    conversation pass through one task, one batch in memory at a time.
    """
    kind = turns.select("conv_id", F.lit("").alias("sha256")).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != name:
                    if state is not None:
                        done.append({"conv_id": name, "sha256": state.hexdigest()})
                    name, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(done, arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": name, "sha256": state.hexdigest()}], arrow)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position", "part").select("conv_id", "role", "text").mapInArrow(run, kind)
