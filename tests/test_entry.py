"""The entry module, also where the corpus operators are missing."""

import importlib.util
import os
import sys

import pytest

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")


def loaded():
    spec = importlib.util.spec_from_file_location("entry_under_test", ENTRY)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("blocked", ["downfield.llm", "corpus_pipeline"])
def test_entry_without_the_corpus_operators(spark, monkeypatch, blocked):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("downfield.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, blocked, None)
    entry = loaded()
    assert entry.entry(spark).count() == 32
    assert "season_stats" in entry.queries() and "season_stats" in entry.oracle_sql()
    assert "pipeline" not in entry.queries()
    assert blocked == "corpus_pipeline" or not any(name.startswith("op") for name in entry.queries())
