"""Position of every row in its group, for groups of any size, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import stored


def _changes(batch: pa.RecordBatch, group: list[str], before: tuple | None) -> np.ndarray:
    """True where a row's group differs from that of the row before it; `before` is the last batch's last group."""
    new = np.zeros(len(batch), bool)
    for name in group:
        column = batch.column(name)
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        empty = pc.is_null(column).to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (empty[1:] & empty[:-1]))
    new[0] = before is None or before != tuple(batch.column(n)[0].as_py() for n in group)
    return new


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with `_idx`, the 0-based position in the group by `order` (nulls first, strings bytewise).

    One range sort over group and order: a large group spreads over many tasks. Each task
    numbers its runs of a group as they stream by; only a task's first run can continue an
    earlier task's last one, so what the tasks exchange is one row a task, whatever the number
    of rows or groups. The numbered rows are a table in the shared folder, so a number never
    changes once given. Rows equal in group and order are numbered in any order; `order`
    should hold every column that matters. An empty table stays empty.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, seen, before = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            if not len(batch):
                continue
            new = _changes(batch, group, before)
            runs = run + np.cumsum(new)
            starts = np.where(new, np.arange(len(batch)), -seen)
            local = np.arange(len(batch)) - np.maximum.accumulate(starts)
            run, seen, before = int(runs[-1]), int(local[-1]) + 1, tuple(batch.column(n)[-1].as_py() for n in group)
            extra = [np.full(len(batch), part, np.int64), runs.astype(np.int64), local.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], names=[*batch.schema.names, "_part", "_run", "_local"])

    schema = rows.withColumns({c: F.lit(0).cast("long") for c in ("_part", "_run", "_local")}).schema
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema))
    ends = placed.groupBy("_part").agg(F.min(F.struct("_run", *group)).alias("head"), F.max(F.struct("_run", "_local", *group)).alias("tail"))
    offsets, before = [], None
    for row in ends.orderBy("_part").collect():  # one row a task
        head, (run, local, *tail) = list(row.head)[1:], row.tail
        ahead = before[1] if before is not None and before[0] == head else 0
        offsets.append((row._part, ahead))
        before = (tail, local + 1 + (ahead if run == 0 else 0))
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _ahead long")
    idx = F.col("_local") + F.when(F.col("_run") == 0, F.col("_ahead")).otherwise(0)
    return placed.join(F.broadcast(table), "_part").select(*rows.columns, idx.alias("_idx"))
