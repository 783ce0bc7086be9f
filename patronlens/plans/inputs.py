"""Inputs shared by the registered queries, derived from the given tables.

Profiles and affinities are the tables every later step starts from. They are
written once per session and folder (a reliable checkpoint in the shared folder)
and reused, the way a job chain would read a materialised `profiles` table. The
`fresh_*` builders compute them from the events each time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from patronlens.functions.lineage import cut
from patronlens.operators import identity, profiles
from patronlens.sources import retail

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def _written(spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut(build(spark, folder))
    return _WRITTEN[key]


def web_merge_map(spark: SparkSession, folder: str) -> DataFrame:
    return identity.resolve_merges(retail.web_id_history(spark, folder))


def web_resolved(spark: SparkSession, folder: str) -> DataFrame:
    return identity.remap_customers(retail.web_events(spark, folder), web_merge_map(spark, folder))


def fresh_web_profiles(spark: SparkSession, folder: str, leading: bool = False) -> DataFrame:
    return profiles.build_profiles(web_resolved(spark, folder), retail.instant(retail.WEB_REFERENCE), leading=leading)


def fresh_shop_profiles(spark: SparkSession, folder: str, leading: bool = False) -> DataFrame:
    return profiles.build_profiles(retail.shop_events(spark, folder), retail.instant(retail.SHOP_REFERENCE), leading=leading)


def fresh_shop_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.category_affinity(retail.shop_events(spark, folder))


def fresh_web_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.category_affinity(web_resolved(spark, folder))


def web_profiles(spark: SparkSession, folder: str, leading: bool = False) -> DataFrame:
    """The written profiles, with the columns of the leading category if asked for; these come from the same pass over the events."""
    written = _written(spark, folder, "web_profiles", partial(fresh_web_profiles, leading=True))
    return written if leading else written.drop(*profiles.LEADING)


def shop_profiles(spark: SparkSession, folder: str, leading: bool = False) -> DataFrame:
    """See `web_profiles`."""
    written = _written(spark, folder, "shop_profiles", partial(fresh_shop_profiles, leading=True))
    return written if leading else written.drop(*profiles.LEADING)


def web_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, "web_affinity", fresh_web_affinity)


def shop_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, "shop_affinity", fresh_shop_affinity)
