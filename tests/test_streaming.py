import tempfile

from pyspark.sql import functions as F

from patronlens.plans import inputs
from patronlens.plans.streaming_queries import _stream
from patronlens.sources import retail
from patronlens.streaming import events as streaming

FOLDER = "/root/testdata/sf0.001"


def totals(frame):
    return {r["customer_id"]: (r["n_events"], r["purchases"], r["revenue"], r["first_seen"]) for r in streaming.roll_up(frame).collect()}


def test_appended_partials_of_finished_days_equal_the_batch(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    streaming.write_partials(_stream(spark, FOLDER).withWatermark("ts", "1 hour"), f"{base}/out", f"{base}/state").awaitTermination()
    written = spark.read.parquet(f"{base}/out")
    batch = streaming.daily_partials(retail.web_events(spark, FOLDER))
    # a day is emitted once the watermark has passed it, so the last one is still open
    closed = batch.where(F.col("day") <= written.agg(F.max("day")).scalar())
    assert written.count() > 0 and totals(written) == totals(closed)


def test_rolled_up_partials_equal_the_profiles(spark):
    rows = totals(streaming.daily_partials(inputs.web_resolved(spark, FOLDER)))
    for p in inputs.fresh_web_profiles(spark, FOLDER).collect():
        assert rows[p["customer_id"]] == (p["total_events"], p["total_purchases"], p["total_revenue"], p["first_seen"])


def _event(number, customer, day, amount=None):
    kind = "purchase" if amount is not None else "session_start"
    return (f"e{number}", customer, kind, f"2024-01-{day:02d} 10:00:00", amount, None, None)


def _merge(past, target, day):
    return (None, None, None, f"2024-01-{day:02d} 12:00:00", None, past, target)


BATCHES = [
    [_event(1, "a", 1, 5.0), _event(2, "b", 2), _event(3, "c", 3, 7.0)],
    [_merge("a", "b", 4), _event(4, "a", 5), _event(5, "c", 5)],
    [_merge("b", "c", 6)],
    [_event(6, "a", 7, 1.0), _event(7, "d", 8), _merge("x", "y", 8)],
]


def _batch(spark, rows):
    frame = spark.createDataFrame(rows, "event_id string, customer_id string, event_type string, at string, total_amount double, past_id string, internal_customer_id string")
    return frame.select("*", F.col("at").cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("order_total")).drop("at")


def _book(ledger):
    return {r.customer_id: (r.n_events, float(r.revenue), str(r.first_seen)[:10], str(r.last_purchase)[:10]) for r in ledger.totals().collect()}


def test_late_merges_move_what_was_written(spark):
    from patronlens.streaming.ledger import Ledger

    ledger = Ledger(spark, tempfile.mkdtemp(prefix="ledger-"))
    assert _book(ledger) == {}
    expected = [
        {"a": (1, 5.0, "2024-01-01", "2024-01-01"), "b": (1, 0.0, "2024-01-02", "None"), "c": (1, 7.0, "2024-01-03", "2024-01-03")},
        {"b": (3, 5.0, "2024-01-01", "2024-01-01"), "c": (2, 7.0, "2024-01-03", "2024-01-03")},
        {"c": (5, 12.0, "2024-01-01", "2024-01-03")},
        {"c": (6, 13.0, "2024-01-01", "2024-01-07"), "d": (1, 0.0, "2024-01-08", "None")},
    ]
    for number, (rows, want) in enumerate(zip(BATCHES, expected, strict=True)):
        # a batch that is repeated after a failure, merges and all, leaves the same ledger
        for _ in range(2):
            ledger.fold(_batch(spark, rows), number)
            assert _book(ledger) == want
    days = {(r.customer_id, str(r.day)[:10]): r.n_events for r in ledger.days().collect()}
    assert days == {("c", f"2024-01-{d:02d}"): n for d, n in ((1, 1), (2, 1), (3, 1), (5, 2), (7, 1))} | {("d", "2024-01-08"): 1}


def test_one_hot_customer_is_split(spark):
    """Rows of one customer land in as many join keys as there are salts."""
    from patronlens.functions.joins import SALTS
    from patronlens.streaming.ledger import remapped

    events = spark.range(2000).select(F.col("id").cast("string").alias("event_id"), F.lit("hot").alias("customer_id"))
    link = spark.createDataFrame([("hot", "cool", 1)], "past_id string, canonical_id string, depth long")
    out = remapped(events, link)
    assert out.groupBy("customer_id").count().collect() == [("cool", 2000)] and SALTS > 1
