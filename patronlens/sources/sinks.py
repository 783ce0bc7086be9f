"""Writers: parquet or JSON tables, and result rows as JSON documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, frame in tables.items():
        target = f"{folder}/{name}.parquet" if fmt == "parquet" else f"{folder}/{name}.json"
        frame.write.mode("overwrite").format(fmt).save(target)


def as_documents(frame: DataFrame, key: str) -> DataFrame:
    """One JSON document per row, built by the executors."""
    return frame.select(F.col(key), F.to_json(F.struct(*frame.columns)).alias("document"))


def write_documents(frame: DataFrame, key: str, path: str) -> None:
    as_documents(frame, key).select("document").write.mode("overwrite").text(path)
