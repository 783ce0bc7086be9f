"""Placement of rows by key, and joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
UNFOLDED = 4


def join_unique(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join rows with a lookup that has one row, or a fixed number of rows, per key.

    The rows of a key are split over `SALTS` parts by the hash of `spread` and the
    lookup rows are repeated per part, so no key lands in one task as a whole. A small
    lookup is still broadcast by Spark, on its measured size.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_few(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a lookup whose size is bounded by design, such as one row a category or the square root of the rows.

    Spark cannot see that a checkpointed table is small, and places all rows by the keys before it finds out. The
    lookup is broadcast, so the rows stay where they are.
    """
    return rows.join(F.broadcast(lookup), list(keys), how)


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows placed by `keys` for steps that unfold a row into many; groupings by the keys and more stay in place.

    There are `UNFOLDED` parts for each shuffle partition of the session. The number is given, so
    that adaptive execution does not join parts that only look small while they are folded.
    """
    return rows.repartition(UNFOLDED * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
