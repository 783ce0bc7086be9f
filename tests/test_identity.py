import pytest

from patronlens.operators import identity


def history(spark, *edges):
    return spark.createDataFrame(list(edges), "past_id string, internal_customer_id string").selectExpr(
        "*", "timestamp'2024-01-15 00:00:00' AS merge_timestamp")


def resolved(frame, **kw):
    return {r["past_id"]: (r["canonical_id"], r["depth"]) for r in identity.resolve_merges(frame, **kw).collect()}


def issues(frame, **kw):
    return {(r["past_id"], r["issue"]) for r in identity.merge_issues(frame, **kw).collect()}


def test_chain_star_and_separate_trees(spark):
    frame = history(spark, ("A", "B"), ("B", "C"), ("x1", "X"), ("x2", "X"), ("p", "q"))
    assert resolved(frame) == {"A": ("C", 2), "B": ("C", 1), "x1": ("X", 1), "x2": ("X", 1), "p": ("q", 1)}
    assert issues(frame) == set()


def test_empty_history(spark):
    frame = history(spark, ("a", "b")).where("false")
    assert resolved(frame) == {} and issues(frame) == set()


def test_cycle_and_self_loop_are_reported_not_resolved(spark):
    frame = history(spark, ("A", "B"), ("B", "A"), ("s", "s"), ("t", "A"), ("ok", "fine"))
    assert resolved(frame) == {"ok": ("fine", 1)}
    assert issues(frame) == {("A", "cycle"), ("B", "cycle"), ("t", "cycle"), ("s", "cycle"), ("s", "self_reference")}


def test_duplicate_raises_in_strict_mode(spark):
    frame = history(spark, ("A", "B"), ("A", "B"))
    assert issues(frame) == {("A", "duplicate")}
    with pytest.raises(identity.MergeHistoryError):
        identity.resolve_merges(frame, strict=True)


@pytest.mark.parametrize("length, deep", [(10, set()), (11, {"n0"}), (14, {"n0", "n1", "n2", "n3"})])
def test_depth_limit_is_ten_hops(spark, length, deep):
    frame = history(spark, *[(f"n{i}", f"n{i + 1}") for i in range(length)])
    assert issues(frame) == {(n, "too_deep") for n in deep}
    assert set(resolved(frame)) == {f"n{i}" for i in range(length)} - deep


def test_cycle_longer_than_the_limit_counts_as_too_deep(spark):
    frame = history(spark, *[(f"n{i}", f"n{(i + 1) % 12}") for i in range(12)])
    assert {i for _, i in issues(frame)} == {"too_deep"}


def test_remap_keeps_every_event(spark):
    events = spark.createDataFrame([("1", "A"), ("2", "Z"), ("3", "A")], "event_id string, customer_id string")
    out = identity.remap_customers(events, identity.resolve_merges(history(spark, ("A", "B"), ("B", "C"))))
    assert sorted((r["event_id"], r["customer_id"]) for r in out.collect()) == [("1", "C"), ("2", "Z"), ("3", "C")]
