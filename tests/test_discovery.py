"""Attributes in nested documents, and system fields in any case."""

from patronlens.operators import discovery
from patronlens.plans import discovery_queries
from patronlens.plans.inputs import shop_profiles


def test_objects_are_opened_at_any_depth(spark):
    document = '{"a": {"b": {"c": {"d": {"e": 1, "f": [1, 2, 3]}}}}, "Session_ID": "s", "g": {}}'
    rows = spark.createDataFrame([("e1", "c1", "view_item", None, document), ("e2", "c2", "view_item", None, None)], "event_id string, customer_id string, event_type string, ts timestamp, document string")
    found = {(r.path, r.value) for r in discovery.json_attribute_rows(rows, "document").collect()}
    assert found == {("a.b.c.d.e", "1"), ("a.b.c.d.f", "[list:3]"), *[(p, discovery.OBJECT) for p in ("a", "a.b", "a.b.c", "a.b.c.d", "g")]}


def test_system_fields_match_in_any_case(spark):
    rows = spark.createDataFrame([("e1", "c1", "view_item", None, {"Session_ID": "s", "colour": "red", "ORDER_TIMESTAMP": "x"})], "event_id string, customer_id string, event_type string, ts timestamp, attributes map<string,string>")
    assert [r.path for r in discovery.attribute_rows(rows).collect()] == ["colour"]


def test_origin_and_samples_of_paths(spark):
    rows = [(f"e{i}", f"c{i % 5}", "purchase" if i % 2 else "view_item", None, {"colour": f"v{i % 40}", "same": "x"} if i else {"colour": None}) for i in range(200)]
    frame = spark.createDataFrame(rows, "event_id string, customer_id string, event_type string, ts timestamp, attributes map<string,string>")
    found = [{r.path: r for r in discovery.field_profile(discovery.attribute_counts(discovery.attribute_rows(frame.repartition(n)))).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    colour, same = found[0]["colour"], found[0]["same"]
    assert colour.source_types == ["purchase", "view_item"] and same.sample_values == ["x"] and colour.nulls == 1
    assert len(colour.sample_values) == discovery.SAMPLES and set(colour.sample_values) <= {f"v{i}" for i in range(40)}


def test_a_container_is_no_trait(spark):
    rows = spark.createDataFrame([(f"e{i}", f"c{i}", "view_item", None, '{"a": {"b": "%d"}}' % (i % 3)) for i in range(30)], "event_id string, customer_id string, event_type string, ts timestamp, document string")
    found = {r.path: r for r in discovery.classify(discovery.field_profile(discovery.attribute_counts(discovery.json_attribute_rows(rows, "document")))).collect()}
    assert (found["a"].occurrences, found["a"].distinct_values, found["a"].customers, found["a"].sample_values, found["a"].status) == (30, 0, 0, [], "text")
    assert found["a.b"].status == "usable"


def test_no_step_deals_rows_by_path(spark):
    schema = "event_id string, customer_id string, event_type string, ts timestamp, attributes map<string,string>"
    rows = spark.createDataFrame([(f"e{i}", f"c{i % 9}", "purchase", None, {"colour": f"v{i % 3}", "size": "s" if i % 4 else None, "Session_ID": "x"}) for i in range(90)], schema)
    counts = discovery.attribute_counts(discovery.attribute_rows(rows))
    usable = discovery.classify(discovery.field_profile(counts)).where("status = 'usable'").localCheckpoint()
    found = discovery.dominant_values(counts, usable)
    assert {(r.customer_id, r.path, r.value) for r in found.collect()} == {(f"c{i}", "colour", f"v{i % 3}") for i in range(9)}
    assert discovery.dominant_values(counts, usable.where("false")).isEmpty()
    plan = discovery.dominant_values(counts, usable)._jdf.queryExecution().executedPlan().toString()
    # one placement by customer serves the counts and the dominant values
    own = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(own) == 1 and "hashpartitioning(customer_id" in own[0], plan


def test_dominant_values_take_one_pass_over_the_events(spark, monkeypatch):
    """No second reading of the events, and neither profiles nor scores are made for it."""
    calls, count = [], discovery_queries._counts
    monkeypatch.setattr(discovery_queries, "_FIELDS", {}, raising=False)
    monkeypatch.setattr(discovery_queries, "_MADE", {})
    monkeypatch.setattr(discovery_queries, "_counts", lambda *at: calls.append("events") or count(*at))
    monkeypatch.setattr(discovery_queries, "shop_profiles", lambda *at, **more: calls.append("profiles") or shop_profiles(*at, **more))
    assert discovery_queries.dominant_attribute_values(spark, "/root/testdata/sf0.001").count() > 0
    assert calls == ["events"]
