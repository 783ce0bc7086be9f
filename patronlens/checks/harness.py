"""Run one registered query on both engines and compare the values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return str(value)


def compare(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    relation = con.sql(sql)
    ours = sorted(frame.columns)
    theirs = sorted(relation.columns)
    if ours != theirs:
        return f"columns differ: {ours} vs {theirs}"
    loose = [f"{c} {t}" for c, t in zip(relation.columns, relation.types) if str(t) not in ("BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN")]
    loose += [f"{c} {t}" for c, t in frame.dtypes if t not in ("bigint", "double", "string", "boolean")]
    if loose:
        return f"column types: {loose}"
    left = Counter(tuple(_plain(row[c]) for c in ours) for row in frame.collect())
    order = [relation.columns.index(c) for c in ours]
    right = Counter(tuple(_plain(row[i]) for i in order) for row in relation.fetchall())
    if left == right:
        return None
    only_left, only_right = list((left - right).items())[:2], list((right - left).items())[:2]
    return (f"rows {sum(left.values())} vs {sum(right.values())}; columns {ours}; "
            f"only spark {only_left}; only sql {only_right}")
