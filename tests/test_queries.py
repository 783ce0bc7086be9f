import pytest

import __spark_entry__ as entry
from patronlens.checks.harness import compare, duck

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "profiles_value_by_behavior", "customer_profiles_web", "merge_history_issues", "raw_rows_to_events", "customer_traits_web", "loyalty_threshold",
    "champion_summary", "label_agreement", "segment_validation", "category_whitespace", "trait_scores", "clv_feature_matrix", "streamed_partials_rollup",
    "trait_p_values", "segment_priority", "late_merges_ledger", "attribute_profile", "clv_cross_validation", "category_whitespace_predicted",
)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 150
    corpus = [n for n in queries if n == "pipeline" or n.startswith("op") and n[2:3].isdigit()]
    assert len(corpus) in (0, 14)  # all of the corpus operators and their pipeline, or none where that part is left out


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
