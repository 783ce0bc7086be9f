"""Identity resolution: past customer ids to the canonical id they were merged into.

The merge history is a functional graph (one out-edge per past id). Each round
joins every walk with the walk that starts where it ends, which doubles its
length, so a chain of depth d needs about log2(d) rounds. Chains that run into a
cycle or past `max_depth` are reported as issues instead of failing mid-job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.functions.lineage import cut


class MergeHistoryError(ValueError):
    """Raised in strict mode when the history has at least one issue."""


def _edges(history: DataFrame) -> DataFrame:
    """One edge per past id; conflicting rows keep the earliest, then smallest target."""
    order = F.struct(F.coalesce(F.col("merge_timestamp"), F.lit("9999-12-31").cast("timestamp")), "internal_customer_id")
    return history.groupBy("past_id").agg(F.min_by("internal_customer_id", order).alias("target"))


def _walks(history: DataFrame, max_depth: int) -> DataFrame:
    """past_id with the array of ids visited when the chain is followed."""
    walk = cut(_edges(history).select("past_id", F.array("target").alias("path"), F.lit(True).alias("grown")))
    rounds = math.ceil(math.log2(max_depth + 1)) + 1
    for _ in range(rounds):
        step = walk.select(F.col("past_id").alias("from_id"), F.col("path").alias("tail"))
        joined = walk.join(step, F.element_at("path", -1) == F.col("from_id"), "left")
        walk = cut(joined.select(
            "past_id",
            # a walk longer than the limit needs no more nodes: its verdict is already known
            F.slice(F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", "tail")), 1, max_depth + 2)
            .alias("path"),
            (F.col("tail").isNotNull() & (F.size("path") <= max_depth)).alias("grown"),
        ))
        if walk.where("grown").isEmpty():
            break
    return walk


def _verdicts(history: DataFrame, max_depth: int) -> DataFrame:
    walk = _walks(history, max_depth)
    visited = F.concat(F.array("past_id"), F.col("path"))
    # position i of the path repeats when the id already stands before it
    repeats = F.exists(
        F.sequence(F.lit(0), F.least(F.size("path"), F.lit(max_depth)) - 1),
        lambda i: F.array_contains(F.slice(visited, 1, i + 1), F.element_at(F.col("path"), i + 1)),
    )
    return walk.select(
        "past_id",
        F.element_at("path", -1).alias("canonical_id"),
        F.size("path").cast("bigint").alias("depth"),
        F.when(repeats, "cycle").when(F.size("path") > max_depth, "too_deep").alias("problem"),
    )


def resolve_merges(history: DataFrame, max_depth: int = 10, strict: bool = False) -> DataFrame:
    """merge_map(past_id, canonical_id, depth); rows with an issue are left out.

    With `strict=True` any issue (also a past id that occurs twice) raises.
    """
    if strict:
        first = merge_issues(history, max_depth).limit(1).collect()
        if first:
            raise MergeHistoryError(f"{first[0]['issue']}: {first[0]['past_id']}")
    return _verdicts(history, max_depth).where(F.col("problem").isNull()).drop("problem")


def merge_issues(history: DataFrame, max_depth: int = 10) -> DataFrame:
    """Every issue of the history: duplicate, self_reference, cycle, too_deep."""
    repeated = history.groupBy("past_id").count().where("count > 1").select("past_id", F.lit("duplicate").alias("issue"))
    selfish = history.where(F.col("past_id") == F.col("internal_customer_id")).select(
        "past_id", F.lit("self_reference").alias("issue")).distinct()
    broken = _verdicts(history, max_depth).where(F.col("problem").isNotNull()).select("past_id", F.col("problem").alias("issue"))
    return repeated.unionByName(selfish).unionByName(broken)


def remap_customers(events: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Events under their canonical customer id; unmapped ids pass through.

    No broadcast hint: the map grows with the customer base, so Spark decides by
    its measured size. Every event keeps exactly one row because past ids are unique.
    """
    link = merge_map.select(F.col("past_id").alias("_past"), F.col("canonical_id").alias("_canonical"))
    joined = events.join(link, events["customer_id"] == F.col("_past"), "left")
    return joined.withColumn("customer_id", F.coalesce("_canonical", "customer_id")).drop("_past", "_canonical")


def ids_by_customer(merge_map: DataFrame) -> DataFrame:
    """All known ids of each merged customer, one row per id, canonical id first."""
    own = merge_map.select(F.col("canonical_id"), F.col("canonical_id").alias("known_id")).distinct().withColumn("is_canonical", F.lit(True))
    past = merge_map.select("canonical_id", F.col("past_id").alias("known_id")).withColumn("is_canonical", F.lit(False))
    return own.unionByName(past)


def merged_id_counts(merge_map: DataFrame) -> DataFrame:
    return merge_map.groupBy(F.col("canonical_id").alias("customer_id")).agg(F.count("*").alias("merged_ids"))


def merge_statistics(history: DataFrame, merge_map: DataFrame) -> DataFrame:
    """One row: merges, canonical ids, average and greatest chain depth."""
    rows = history.agg(F.count("*").alias("total_past_ids"))
    return merge_map.agg(
        F.count_distinct("canonical_id").alias("unique_canonical_ids"),
        F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_chain_depth"),
        F.coalesce(F.max("depth"), F.lit(0)).cast("bigint").alias("max_chain_depth"),
        F.count_distinct("canonical_id").alias("customers_with_merges"),
    ).withColumn("total_past_ids", rows.scalar())


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(F.count("*").alias("n_events"))
