"""Connected components of a link table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every linked node with the smallest node of its component.

    Large-star and small-star steps in turn: each joins a node's larger neighbours to its
    smallest neighbour, then each node and its smaller neighbours to the smallest, until no
    link moves. Groups are only ever reduced to a minimum, so a hub with any number of links
    is combined before the shuffle. Each round is a table in the shared folder, so a lost
    executor costs one round. Links with a null end, and self links, are ignored.
    """
    one, two = F.col(a), F.col(b)
    edges = stored(links.where(one != two).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct())
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct())
        # done when the links are stars: one root for each node, and no root is a node
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").limit(1).count():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
