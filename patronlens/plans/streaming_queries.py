"""Registered queries: the streaming jobs run to completion over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronlens.checks.base_sql import WEB, with_
from patronlens.functions.columns import r6
from patronlens.functions.lineage import shared_folder
from patronlens.plans.inputs import web_merge_map, web_resolved
from patronlens.plans.registry import query
from patronlens.sources import retail
from patronlens.streaming import events as streaming
from patronlens.streaming import ledger as ledgers

_TOTALS = """SELECT customer_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  round(CAST(coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE), 6) AS revenue, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts,
  count(*) FILTER (WHERE event_type = 'session_start') AS sessions FROM web_ev GROUP BY 1"""


def _shown(frame):
    return streaming.roll_up(frame).select("customer_id", "n_events", "purchases", r6(F.col("revenue")).alias("revenue"), "carts", "sessions")


@query("daily_partials_rollup", with_(WEB, select=_TOTALS))
def daily_partials_rollup(spark, folder):
    return _shown(streaming.daily_partials(web_resolved(spark, folder)))


@query("daily_partials", with_(WEB, select="""SELECT customer_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM web_ev GROUP BY 1, 2"""))
def daily_partials(spark, folder):
    rows = streaming.daily_partials(web_resolved(spark, folder))
    return rows.select("customer_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_events", "purchases")


def _stream(spark, folder):
    """The event table as a stream of its parquet file, in canonical form."""
    schema = retail.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return retail.web_events_from(raw)


@query("streamed_remap", with_(WEB, select="SELECT customer_id, count(*) AS n_events FROM web_ev GROUP BY 1"))
def streamed_remap(spark, folder):
    base = shared_folder(spark)
    job = (streaming.remap_stream(_stream(spark, folder), web_merge_map(spark, folder), "40 days").writeStream.format("parquet")
           .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("customer_id").agg(F.count("*").alias("n_events"))


@query("streamed_partials_rollup", with_(WEB, select=_TOTALS))
def streamed_partials_rollup(spark, folder):
    base = shared_folder(spark)
    rows = streaming.remap_stream(_stream(spark, folder), web_merge_map(spark, folder), "40 days")

    def fold(batch, number):
        # each micro-batch writes its own additive partials; a replayed batch overwrites itself
        streaming.daily_partials(batch).write.mode("overwrite").parquet(f"{base}/partials/batch={number}")

    rows.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.parquet(f"{base}/partials"))


@query("late_merges_ledger", with_(WEB, select=_TOTALS))
def late_merges_ledger(spark, folder):
    """Half of the events, then half of the merges, the other events, and the last merges: each a run of the same stream.

    The oracle knows nothing of this order: it counts all events under all merges.
    """
    base = shared_folder(spark)
    events, merges = retail.web_events(spark, folder), retail.web_id_history(spark, folder)
    rows = ledgers.with_merges(events, merges)
    schema = rows.schema
    kind, early = F.col("past_id").isNotNull(), F.pmod(F.xxhash64(F.coalesce("past_id", F.lit(""))), F.lit(2)) == 0
    middle = events.agg(F.timestamp_seconds(F.avg(F.unix_seconds("ts")))).scalar()
    steps = [~kind & (F.col("ts") < middle), kind & early, ~kind & (F.col("ts") >= middle), kind & ~early]
    book = ledgers.Ledger(spark, f"{base}/ledger")
    for number, step in enumerate(steps):
        rows.where(step).write.parquet(f"{base}/source/step={number}")
        source = spark.readStream.schema(schema).parquet(f"{base}/source/*")
        ledgers.run(source, book, f"{base}/state").awaitTermination()
    shown = book.totals().select("customer_id", "n_events", "purchases", r6(F.col("revenue").cast("double")).alias("revenue"), "carts", "sessions")
    return shown
