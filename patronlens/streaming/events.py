"""Streaming remap and additive profile partials.

Only measures that merge are kept per customer and day; favourite times, gaps and
affinities depend on all events of a customer and stay in the batch job. Events
later than the watermark are dropped here and corrected by the next batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.functions.joins import join_unique
from patronlens.operators.profiles import PAGE_VIEWS, amount

ADDED = ("n_events", "purchases", "revenue", "refunds", "sessions", "page_views", "item_views", "carts")


def remap_stream(events: DataFrame, merge_map: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Stream-static left join with the merge map; a repeated event id inside the watermark counts once."""
    unique = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    # a stream has no adaptive skew handling, so a customer with many events is split by the event
    link = merge_map.select(F.col("past_id").alias("customer_id"), F.col("canonical_id").alias("_canonical"))
    joined = join_unique(unique, link, ["customer_id"], F.col("event_id"), "left")
    return joined.withColumn("customer_id", F.coalesce("_canonical", "customer_id")).drop("_canonical")


def daily_partials(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Additive measures per customer and day; runs on a stream and on a table alike.

    A watermark that the input already carries is kept, a table ignores it.
    """
    kind = F.col("event_type")
    rows = events.withColumn("amount", amount(events))
    if not events.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy("customer_id", F.window("ts", "1 day")).agg(
        F.count("*").alias("n_events"), F.count_if(kind == "purchase").alias("purchases"),
        F.sum(F.when(kind == "purchase", F.col("amount"))).alias("revenue"), F.count_if(kind == "refund").alias("refunds"),
        F.count_if(kind == "session_start").alias("sessions"), F.count_if(kind.isin(*PAGE_VIEWS)).alias("page_views"),
        F.count_if(kind == "view_item").alias("item_views"), F.count_if(kind == "add_to_cart").alias("carts"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min(F.when(kind == "purchase", F.col("ts"))).alias("first_purchase"), F.max(F.when(kind == "purchase", F.col("ts"))).alias("last_purchase"),
    ).select("customer_id", F.col("window.start").alias("day"), *ADDED, "first_seen", "last_seen", "first_purchase", "last_purchase")


def roll_up(partials: DataFrame) -> DataFrame:
    """Customer totals from daily partials."""
    return partials.groupBy("customer_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ADDED], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("first_purchase").alias("first_purchase"), F.max("last_purchase").alias("last_purchase"))


def write_partials(events: DataFrame, path: str, checkpoint: str, lateness: str = "1 day"):
    """Append finished days to a parquet table; the checkpoint folder makes the query restartable."""
    return (daily_partials(events, lateness).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
