"""Canonical events from a star schema: a web click log and an order book.

Both adapters give the same columns: event_id, customer_id, event_type, ts,
total_amount, order_total, product_category, category_level_1..3, device_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = (
    "event_id", "customer_id", "event_type", "ts", "total_amount", "order_total",
    "product_category", "category_level_1", "category_level_2", "category_level_3", "device_type",
)

WEB_REFERENCE = "2024-02-01 00:00:00"
SHOP_REFERENCE = "2001-09-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Session setting for local runs on small single-split files: how many parts to deal a table to. Unset on a cluster.
INPUT_PARTS = "spark.patronlens.inputParts"


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Deal a table to the parts that the session asks for; without that setting nothing is shuffled, at any size."""
    parts = frame.sparkSession.conf.get(INPUT_PARTS, None)
    return frame.repartition(int(parts), key) if parts else frame


def instant(text: str):
    return F.lit(text).cast("timestamp")


def _null(kind: str):
    return F.lit(None).cast(kind)


def web_events(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("event_id", "user_id", "event_type", "ts", "value", "props")
    return web_events_from(spread(table(spark, folder, "events").select(*columns), "event_id"))


def web_events_from(log: DataFrame) -> DataFrame:
    """Canonical form of the click log, for a table or a stream."""
    kinds = F.create_map(*[F.lit(x) for pair in (
        ("signup", "session_start"), ("view", "view_item"), ("click", "add_to_cart"),
        ("purchase", "purchase"), ("error", "refund")) for x in pair])
    raw = log.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        kinds[F.col("event_type")].alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.from_json("props", "k INT")["k"].alias("k"),
    )
    bucket = (F.col("k") % 5).cast("string")
    return raw.select(
        "event_id", "customer_id", "event_type", "ts",
        F.when(F.col("event_type").isin("purchase", "refund"), F.col("amount")).alias("total_amount"),
        _null("decimal(18,2)").alias("order_total"),
        _null("string").alias("product_category"),
        F.concat(F.lit("c"), bucket).alias("category_level_1"),
        F.concat(F.lit("c"), bucket, F.lit("_"), (F.col("k") % 20).cast("string")).alias("category_level_2"),
        _null("string").alias("category_level_3"),
        F.when(F.col("k") % 3 == 0, "mobile").when(F.col("k") % 3 == 1, "desktop").alias("device_type"),
    )


def web_id_history(spark: SparkSession, folder: str) -> DataFrame:
    """Users ending in 7 or 8 were merged into the user one below, so 8 -> 7 -> 6 is a chain."""
    users = table(spark, folder, "events").select("user_id").where(F.col("user_id") % 10 >= 7).where(
        F.col("user_id") % 10 <= 8).distinct()
    return users.select(
        F.col("user_id").cast("string").alias("past_id"),
        (F.col("user_id") - 1).cast("string").alias("internal_customer_id"),
        instant("2024-01-15 00:00:00").alias("merge_timestamp"),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with customer, order time and part attributes."""
    lines = spread(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"), "l_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )


def line_kind():
    """A returned first line is a refund, an N line a view, any other line a purchased item."""
    return (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "refund")
        .when(F.col("l_returnflag") == "N", "view_item")
        .otherwise("purchase_item")
    )


def shop_events(spark: SparkSession, folder: str) -> DataFrame:
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    bare = [_null("decimal(18,2)").alias("order_total"), _null("string").alias("product_category")]
    no_category = [_null("string").alias(f"category_level_{i}") for i in (1, 2, 3)]
    key = F.col("o_orderkey").cast("string")
    at = F.col("o_orderdate").cast("timestamp")
    buyer = F.col("o_custkey").cast("string").alias("customer_id")
    # one pass over orders gives both the session and the purchase row
    visits = orders.select(
        key.alias("k"), buyer, at.alias("at"), money.alias("money"),
        F.explode(F.array(F.lit("session_start"), F.lit("purchase"))).alias("event_type"),
    ).select(
        F.concat(F.when(F.col("event_type") == "purchase", "p").otherwise("s"), F.col("k")).alias("event_id"),
        "customer_id", "event_type",
        F.when(F.col("event_type") == "purchase", F.col("at"))
        .otherwise(F.col("at") - F.expr("INTERVAL '1' HOUR")).alias("ts"),
        F.when(F.col("event_type") == "purchase", F.col("money")).alias("total_amount"),
        *bare, *no_category, _null("string").alias("device_type"),
    )
    items = order_lines(spark, folder).select(
        F.concat(F.lit("l"), key, F.lit("_"), F.col("l_linenumber").cast("string")).alias("event_id"),
        buyer, line_kind().alias("event_type"), at.alias("ts"),
        _null("decimal(18,2)").alias("total_amount"), *bare,
        F.col("p_type").alias("category_level_1"), F.col("p_brand").alias("category_level_2"),
        _null("string").alias("category_level_3"), _null("string").alias("device_type"),
    )
    return visits.unionByName(items)


def shop_item_events(spark: SparkSession, folder: str) -> DataFrame:
    """Product events with a free attribute map, the input of attribute discovery."""
    attributes = F.create_map(
        F.lit("brand"), F.col("p_brand"),
        F.lit("type"), F.col("p_type"),
        F.lit("size"), F.col("p_size").cast("string"),
        F.lit("color"), F.element_at(F.split("p_name", " "), 1),
        F.lit("order_priority"), F.col("o_orderpriority"),
        F.lit("shipping_state"), F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")),
        F.lit("line_ref"), F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        F.lit("order_id"), F.col("o_orderkey").cast("string"),
    )
    return order_lines(spark, folder).select(
        F.concat_ws("_", F.lit("l"), F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when((line_kind() == "purchase_item") & (F.col("l_linestatus") == "O"), "purchase").otherwise(line_kind()).alias("event_type"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        attributes.alias("attributes"),
    )
