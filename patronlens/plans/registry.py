"""Registered queries: a name, a Spark builder and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def keep(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, oracle)
        return build

    return keep


def load_all() -> dict[str, Query]:
    from patronlens.plans import (  # noqa: F401
        profile_queries,
        source_queries,
        report_queries,
        segment_queries,
        scoring_queries,
        whitespace_queries,
        discovery_queries,
        clv_queries,
        streaming_queries,
    )

    return QUERIES
