"""Ordered picks inside an aggregate, so that no group is ever collected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick_first(value: Column, *order: Column, where: Column | None = None) -> Column:
    """Value of the row that sorts first by `order`, among rows passing `where`.

    `min_by` over a struct merges on the map side, which makes it safe for a
    group that holds a large share of the table.
    """
    key = F.struct(*order)
    if where is not None:
        return F.min_by(F.when(where, value), F.when(where, key))
    return F.min_by(value, key)


def ranked_first(candidates: Column) -> Column:
    """Smallest struct of a short array (lexicographic by field)."""
    return F.array_min(F.array_compact(candidates))
