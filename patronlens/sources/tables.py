"""Readers for folders of source tables: events, merge history, customer attributes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from patronlens.functions.columns import non_empty
from patronlens.sources.mapping import NON_EVENT_TABLES, FieldMapping, SourceConfig, mapped_value, nested, rows_to_events

# Customer attribute -> name in the output.
CUSTOMER_ATTRIBUTES = {
    "email": "email", "first_name": "first_name", "last_name": "last_name", "country": "country", "language": "language",
    "gender": "gender", "birth_date": "birth_date", "phone": "phone", "newsletter__f84ca2e7": "newsletter",
    "double_optin": "double_optin", "rfm_today__b3103f82": "rfm_segment", "rfm_simplified_today__da2681cd": "rfm_simplified",
    "engagement_level": "engagement_level",
}


def tables_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the `*.parquet` tables of a folder, files or folders of part files, on any file system Spark reads.

    The file list is a scan like any other that reads no content; what comes back is one row a table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"^.*?/([^/]+)\.parquet(?:/|$)", 1)
    return sorted(r[0] for r in files.select(name.alias("name")).where("name != ''").distinct().collect())


def load_events(
    spark: SparkSession, folder: str, config: SourceConfig | None = None,
    include: Iterable[str] | None = None, exclude: Iterable[str] = (),
) -> tuple[DataFrame | None, dict[str, str]]:
    """Events of every event table of a folder, and the error per table that could not be read."""
    config = config or SourceConfig()
    frames, errors = [], {}
    wanted = None if include is None else set(include)
    for name in tables_in(spark, folder):
        if name in NON_EVENT_TABLES or name in set(exclude) or (wanted is not None and name not in wanted):
            continue
        try:
            frames.append(rows_to_events(spark.read.parquet(f"{folder}/{name}.parquet"), name, config))
        except (AnalysisException, KeyError) as error:
            errors[name] = f"{config.client_name}: {str(error).splitlines()[0]}"
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
    return merged, errors


def events_per_table(events: DataFrame) -> DataFrame:
    return events.groupBy("source_table").agg(F.count("*").alias("n_events"), F.count_distinct("customer_id").alias("customers"))


def history_rows(frame: DataFrame, config: SourceConfig | None = None, rank: int = 0) -> DataFrame:
    """Merge history rows of one table; both ids must be present."""
    config = config or SourceConfig()
    past = non_empty(frame[config.past_id_field].cast("string"))
    current = non_empty(frame[config.canonical_id_field].cast("string"))
    at = frame["merge_timestamp"].cast("timestamp") if "merge_timestamp" in frame.columns else F.lit(None).cast("timestamp")
    return frame.select(past.alias("past_id"), current.alias("internal_customer_id"), at.alias("merge_timestamp"),
                        F.lit(rank).alias("source_rank")).where(F.col("past_id").isNotNull() & F.col("internal_customer_id").isNotNull())


def load_history(spark: SparkSession, folder: str, config: SourceConfig) -> DataFrame | None:
    """Merge history from the table that the source names for it, if it names one."""
    return history_rows(spark.read.parquet(f"{folder}/{config.id_history_table}.parquet"), config) if config.id_history_table else None


def merge_event_rows(frame: DataFrame, config: SourceConfig | None = None, rank: int = 1) -> DataFrame:
    """Merge history rows from merge events whose source ids are an array, JSON text or one bare id."""
    config = config or SourceConfig()
    path = f"{config.properties_field}.source_internal_ids" if config.properties_field else "source_internal_ids"
    ids = nested(frame, path)
    if isinstance(frame.select(ids).schema[0].dataType, T.ArrayType):
        listed = ids.cast("array<string>")
    else:
        text = ids.cast("string")
        # malformed text and plain words are no JSON arrays: then the text itself is the id
        listed = F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array(text))
    current = frame[config.canonical_id_field].cast("string")
    at = frame["merge_timestamp"].cast("timestamp") if "merge_timestamp" in frame.columns else F.lit(None).cast("timestamp")
    rows = frame.select(F.explode(listed).alias("past_id"), current.alias("internal_customer_id"), at.alias("merge_timestamp"),
                        F.lit(rank).alias("source_rank"))
    return rows.where(non_empty(F.col("past_id")).isNotNull() & non_empty(F.col("internal_customer_id")).isNotNull()
                      & (F.col("past_id") != F.col("internal_customer_id")))


def first_history(*sources: DataFrame) -> DataFrame:
    """First row per past id over all sources: by source, then time, then target id."""
    union = reduce(lambda a, b: a.unionByName(b), sources)
    order = F.struct("source_rank", F.coalesce("merge_timestamp", F.lit("9999-12-31").cast("timestamp")), "internal_customer_id")
    return union.groupBy("past_id").agg(
        F.min_by(F.struct("internal_customer_id", "merge_timestamp", "source_rank"), order).alias("r")
    ).select("past_id", "r.*")


def configured_history(frame: DataFrame, past_field: str, current_field: str, limit: int | None = None) -> DataFrame:
    """Merge table as configured: rows without past id are dropped, repeats are kept and later reported."""
    rows = frame.select(frame[past_field].cast("string").alias("past_id"), frame[current_field].cast("string").alias("internal_customer_id"),
                        F.lit(None).cast("timestamp").alias("merge_timestamp"))
    rows = rows.where(non_empty(F.col("past_id")).isNotNull() & non_empty(F.col("internal_customer_id")).isNotNull())
    return rows if limit is None else rows.limit(limit)


def customer_attributes(frame: DataFrame, properties: str = "properties") -> DataFrame:
    """Customer attributes under their fixed output names."""
    ids = [frame[c].cast("string") for c in ("internal_id", "internal_customer_id") if c in frame.columns]
    columns = [(nested(frame, f"{properties}.{source}"), target) for source, target in CUSTOMER_ATTRIBUTES.items()]
    return frame.select(
        F.coalesce(*[non_empty(i) for i in ids]).alias("customer_id"),
        *[(F.lit(None) if c is None else c).cast("string").alias(target) for c, target in columns],
    ).where(F.col("customer_id").isNotNull())


def _from_map(container: Column, name: str) -> Column:
    """Exact key, the key without underscores, else the first key (sorted) that starts with either."""
    bare = name.replace("_", "")
    live = F.map_filter(container, lambda k, v: v.isNotNull())

    def prefixed(start: str) -> Column:
        keys = F.array_sort(F.filter(F.map_keys(live), lambda k: k.startswith(start)))
        return F.try_element_at(live, F.try_element_at(keys, F.lit(1)))

    return F.coalesce(F.try_element_at(live, F.lit(name)), prefixed(name), F.try_element_at(live, F.lit(bare)), prefixed(bare))


def detected_attributes(
    frame: DataFrame, customer_id_field: str, known: Iterable[str], mappings: dict[str, FieldMapping] | None = None,
) -> DataFrame:
    """Configured attributes, then known fields found at the top level or inside property maps."""
    mappings = mappings or {}
    columns = []
    maps = [c for c in ("properties", "raw_properties") if c in frame.columns]
    for name in dict.fromkeys([*mappings, *known]):
        options = []
        if name in mappings:
            options.append(mapped_value(frame, mappings[name]).cast("string"))
        if name in known:
            if name in frame.columns:
                options.append(frame[name].cast("string"))
            options += [_from_map(F.col(m).cast("map<string,string>"), name) for m in maps]
        columns.append((F.coalesce(*options) if options else F.lit(None).cast("string")).alias(name))
    rows = frame.select(frame[customer_id_field].cast("string").alias("customer_id"), *columns)
    return rows.where(non_empty(F.col("customer_id")).isNotNull())


def dataset_statistics(events: DataFrame) -> DataFrame:
    """One row: customers, events, purchases, revenue, events per customer."""
    bought = F.col("event_type") == "purchase"
    return events.agg(
        F.count_distinct("customer_id").alias("n_customers"), F.count("*").alias("n_events"),
        F.count_if(bought).alias("n_purchases"),
        F.coalesce(F.sum(F.when(bought, F.col("total_amount"))), F.lit(0)).cast("double").alias("total_revenue"),
    ).withColumn("avg_events_per_customer", F.coalesce(F.try_divide(F.col("n_events").cast("double"), F.col("n_customers")), F.lit(0.0)))


def event_type_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"))
