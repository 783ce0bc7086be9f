"""Customer-consistent samples: the same customers in every table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Customer id columns that are tried, in this order.
CUSTOMER_ID_FIELDS = ("internal_customer_id", "customer_id", "user_id")
TIME_FIELDS = ("timestamp", "event_timestamp", "created_at", "ts")


def id_field(frame: DataFrame) -> str | None:
    lowered = {c.lower(): c for c in frame.columns}
    return next((lowered[c] for c in CUSTOMER_ID_FIELDS if c in lowered), None)


def _in_range(frame: DataFrame, start: str | None, end: str | None) -> DataFrame:
    when = next((c for c in frame.columns if c.lower() in TIME_FIELDS), None)
    if when is None:
        return frame
    if start is not None:
        frame = frame.where(F.col(when) >= F.lit(start).cast("timestamp"))
    if end is not None:
        frame = frame.where(F.col(when) <= F.lit(end).cast("timestamp"))
    return frame


def sampled_ids(
    tables: Mapping[str, DataFrame], n: int | None, seed: int = 42, start: str | None = None, end: str | None = None,
    rate: float | None = None,
) -> DataFrame:
    """Up to `n` distinct customer ids in hash order, so that reruns pick the same ids."""
    parts = []
    for frame in tables.values():
        name = id_field(frame)
        if name is not None:
            parts.append(_in_range(frame, start, end).select(F.col(name).cast("string").alias("customer_id")))
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.unionByName(part)
    digest = F.md5(F.concat(F.col("customer_id"), F.lit(f":{seed}")))
    ids = ids.where(F.col("customer_id").isNotNull()).distinct().withColumn("digest", digest)
    if rate is not None:
        # first 8 hex digits as a number in [0, 1)
        ids = ids.where(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32) < rate)
    if n is not None:
        ids = ids.orderBy("digest", "customer_id").limit(n)
    return ids.select("customer_id")


def sample_tables(
    tables: Mapping[str, DataFrame], ids: DataFrame, start: str | None = None, end: str | None = None,
    max_rows: int | None = None,
) -> dict[str, DataFrame]:
    """Rows of the sampled customers per table; a semi join replaces id lists in the query text."""
    out = {}
    for name, frame in tables.items():
        key = id_field(frame)
        if key is None:
            continue
        rows = _in_range(frame, start, end)
        rows = rows.join(ids, rows[key].cast("string") == ids["customer_id"], "left_semi")
        out[name] = rows if max_rows is None else rows.limit(max_rows)
    return out
