import tempfile
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from patronlens.sources import mapping, sampling, sinks, tables


def test_folder_is_read_as_events_with_errors_per_table(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    at = datetime(2024, 1, 16, 14)
    good = spark.createDataFrame([("c1", "2024-01-16T14:00:00Z", {"product_id": "p", "price": "29.99"}), (None, "2024-01-16T14:00:00", {}), ("c2", "bad", {})],
                                 "internal_customer_id string, timestamp string, properties map<string,string>")
    other = spark.createDataFrame([(at, "x")], "at timestamp, name string")
    sinks.write_tables({"purchase": good, "strange": other, "merge": other}, folder)
    events, errors = tables.load_events(spark, folder)
    row = events.collect()
    assert len(row) == 1 and row[0]["event_type"] == "purchase" and str(row[0]["product_price"]) == "29.99" and set(errors) == {"strange"}


def test_sample_is_the_same_on_every_partitioning_and_survives_a_round_trip(spark):
    frame = spark.range(5000).selectExpr("cast(id % 97 as string) AS customer_id", "id AS n")
    pick = lambda f: {r[0] for r in sampling.sampled_ids({"t": f}, 10).collect()}
    assert pick(frame.repartition(1)) == pick(frame.repartition(17)) and len(pick(frame)) == 10
    folder = tempfile.mkdtemp(prefix="spark-")
    sample = sampling.sample_tables({"t": frame}, sampling.sampled_ids({"t": frame}, 10))
    sinks.write_tables(sample, folder)
    assert spark.read.parquet(f"{folder}/t.parquet").count() == sample["t"].count()


def test_presets_and_type_values(spark):
    log = spark.createDataFrame([("u", datetime(2024, 1, 1), "purchase"), ("u", datetime(2024, 1, 1), "scroll")],
                                "user_pseudo_id string, event_timestamp timestamp, event_name string").selectExpr("*", "named_struct('value', '5') AS event_params")
    kinds = sorted(r["event_type"] for r in mapping.rows_to_events(log, "events", mapping.ga4()).collect())
    assert kinds == ["purchase", "view_item"]


def test_merge_events_accept_arrays_json_and_bare_ids(spark):
    listed = spark.createDataFrame([("c", {"source_internal_ids": ["a", "c", ""]})], "internal_customer_id string, properties struct<source_internal_ids:array<string>>")
    text = spark.createDataFrame([("c", {"source_internal_ids": '["a","b"]'}), ("d", {"source_internal_ids": "z"})], "internal_customer_id string, properties map<string,string>")
    assert [r["past_id"] for r in tables.merge_event_rows(listed).collect()] == ["a"]
    assert sorted(r["past_id"] for r in tables.merge_event_rows(text).collect()) == ["a", "b", "z"]


def test_tables_of_a_folder_are_files_and_folders(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.range(3).repartition(3).write.parquet(f"{folder}/many.parquet")
    spark.range(3).withColumn("day", F.col("id")).write.partitionBy("day").parquet(f"{folder}/parts.parquet")
    spark.range(3).toPandas().to_parquet(f"{folder}/single.parquet")
    (Path(folder) / "notes.txt").write_text("x")
    assert tables.tables_in(spark, folder) == ["many", "parts", "single"]


def test_limit_takes_rows_with_maps_at_any_depth(spark):
    schema = "customer_id string, timestamp timestamp, properties map<string,string>, deep struct<m:map<string,int>>"
    at = datetime(2024, 1, 1)
    rows = [(f"c{i}", at, {"a": str(i)}, ({"b": i},)) for i in range(6)]
    config = mapping.EventTable("t", "view_item", customer_id_field="customer_id", timestamp_field="timestamp", date_field="timestamp")
    picks = [sorted(r.customer_id for r in mapping.source_rows(spark.createDataFrame(rows, schema).repartition(n), config, limit=4).collect()) for n in (1, 5)]
    assert picks[0] == picks[1] and len(picks[0]) == 4


def test_mobile_values_and_history_table_of_a_source(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("c", at, "Mobile Web"), ("c", at, "iOS app"), ("c", at, "desktop"), ("c", at, None)], "customer_id string, timestamp timestamp, device string")
    found = {r.device_type: r.is_mobile for r in mapping.rows_to_events(rows, "view_item", mapping.generic()).collect()}
    assert found == {"Mobile Web": True, "iOS app": True, "desktop": False, None: False}
    narrow = mapping.SourceConfig("n", "customer_id", "timestamp", None, mobile_values=("tablet",))
    assert not any(r.is_mobile for r in mapping.rows_to_events(rows, "view_item", narrow).collect())
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([("a", "u"), (None, "u"), ("b", "")], "anonymous_id string, user_id string").write.parquet(f"{folder}/identifies.parquet")
    assert [(r.past_id, r.internal_customer_id) for r in tables.load_history(spark, folder, mapping.segment()).collect()] == [("a", "u")]
    assert tables.load_history(spark, folder, mapping.generic()) is None
