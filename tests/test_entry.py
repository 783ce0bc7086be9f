"""The entry points stay usable without the corpus operators and without what those need."""

import importlib
import sys

import pytest


@pytest.fixture
def entry():
    return importlib.import_module("__spark_entry__")


def test_every_oracle_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_missing_package_takes_only_the_corpus_operators_away(entry, monkeypatch):
    everything = set(entry.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("patronlens.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "patronlens.llm", None)
    left = set(entry.queries())
    assert left == {n for n in everything if n != "pipeline" and not n.startswith("op")} and len(left) > 190
    assert set(entry.oracle_sql()) <= left
