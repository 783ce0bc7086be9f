"""Cutting lineage in iterative jobs so that a lost executor does not replay every round."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one up only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def cut(frame: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Rows of a part of a table that many jobs read: at most, and where it would have fewer parts than there are cores.
MOST_ROWS, FEW_ROWS = 250_000, 5_000


def few_parts(table: DataFrame) -> DataFrame:
    """A written table in as many parts as its rows need; no row is shuffled.

    Fits that run a job for every step pay for each part in every job, however few rows it holds.
    """
    rows, cores = table.count(), table.sparkSession.sparkContext.defaultParallelism
    return table.coalesce(max(1, -(-rows // MOST_ROWS), min(cores, -(-rows // FEW_ROWS))))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for tables that later steps read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid4().hex}"
