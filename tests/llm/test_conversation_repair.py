"""Conversation repair: SQL, a search over all edits, blocks of any size, odd rows."""

import hashlib
import heapq

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patronlens.checks.harness import compare, duck
from patronlens.llm import conversation_repair as repair
from patronlens.llm import queries

FOLDER = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _search(rows):
    """Cheapest, then ASCII-least edits by a best-first search over whole audits; rows: (initial, fault, copies of one)."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        for role in "ua":
            if (state, role) in STEP:
                heapq.heappush(heap, (cost + 5, audit + "I", at, role))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if fault < 2:
                if (state, initial) in STEP:
                    heapq.heappush(heap, (cost + 5 * fault, audit + "K", at + 1, initial))
                for role in "ua":
                    if (state, role) in STEP:
                        heapq.heappush(heap, (cost + 5 * fault + 1, audit + "R", at + 1, role))
    raise AssertionError


def _blocks(rows, size):
    """The operator's three passes over blocks of `size` rows."""
    cuts = [rows[i : i + size] for i in range(0, len(rows), size)] or [[]]
    ways, vector, points = [repair._summary(c) for c in cuts], repair._last(), []
    for way in reversed(ways):
        points.append(vector)
        vector = [min(way[4 * q + e] + vector[e] for e in repair.STATES) for q in repair.STATES]
    audit, state = "", 0
    for number, (cut, after) in enumerate(zip(cuts, reversed(points), strict=True)):
        letters, _, state = repair._walk(cut, repair._backward(cut, after), state, number == len(cuts) - 1)
        audit += "".join(letters)
    return vector[0], audit


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 2), st.integers(1, 3)), max_size=7), st.integers(1, 4))
def test_blocks_against_a_search_over_all_edits(rows, size):
    single = [(i, f if n == 0 else 2) for i, f, copies in rows for n in range(copies)]
    assert _blocks(rows, size) == _search(single)


def _plain(rows):
    """rows of one conversation: (turn, role, text) -> gaps, blank, duplicate, truncated, illegal, cost, audit, repaired."""
    rows = sorted(((t is not None, t or 0, (" " if r is None else r), (" " if x is None else x)) for t, r, x in rows), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
    seen, faults, kinds = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        kept = text.strip(BLANKS)
        kind = 0 if not kept else 1 if (role, text) in seen else 2 if kept[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(0 if kind is None else 1 if kind == 2 else 2)
        if kind is not None:
            kinds[kind] += 1
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[0]}
    cost, audit = _blocks([(i, f, 1) for i, f in zip(initials, faults, strict=True)], 10**9) if len(rows) > 12 else _search(list(zip(initials, faults, strict=True)))
    lines, at, state = [], 0, ""
    for letter in audit:
        role = "a" if state == "u" else "u"
        if letter == "I":
            lines, state = [*lines, {"u": "user", "a": "assistant"}[role] + ":"], role
            continue
        _, _, own, text = rows[at]
        at += 1
        if letter == "K":
            lines, state = [*lines, f"{own}:{text}"], own[0]
        elif letter == "R":
            lines, state = [*lines, {"u": "user", "a": "assistant"}[role] + ":" + text], role
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


ODD = {
    1: [(0, "user", "Hi."), (1, "assistant", "Yes."), (2, "user", "More?"), (3, "assistant", "No")],
    2: [(None, "user", "b."), (None, "user", "a."), (None, None, None), (7, "assistant", "a.")],
    3: [(0, "user", "x.")] * 5 + [(4, "user", "x."), (9, "assistant", " \t\n")],
    4: [(0, "", "x."), (1, "tool", "y!"), (2, "é", "z?")],
    5: [(i, "user" if i % 2 == 0 else "assistant", f"text {i}." if i % 7 else "same.") for i in range(40)] + [(3, "system", "late")],
    6: [(0, "system", "s. \x0b"), (0, "assistant", "word " * 20000 + "end.")],
    None: [(0, "user", "null id."), (5, "assistant", "ok.")],
}


@pytest.mark.parametrize("block", [1, 256])
def test_whole_operator_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = [(c, *r, "x", 1) for c, own in ODD.items() for r in own]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, idx int")
    ids = spark.createDataFrame([(99,), (1,), (None,)], "conv_id long")
    found = repair.repair(frame, ids)
    named = {r.conv_id: r.sha256 for r in repair.digests(found.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, named.get(r.conv_id, empty)) for r in found.conversations.collect()}
    assert got == {c: _plain(own) for c, own in ODD.items()} | {99: (0, 0, 0, 0, 0, 0, "", empty)}


def test_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    found = repair.repair(frame)
    assert found.conversations.collect() == [] and found.turns.collect() == [] and repair.digests(found.turns).collect() == []


def test_query_equals_sql(spark):
    assert compare(queries.QUERIES["op11_conversation_repair"](spark, FOLDER), duck(FOLDER), queries.ORACLES["op11_conversation_repair"]) is None
