import importlib
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.queries()) > 60


def test_without_the_training_data_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(entry)
        assert not any(n.startswith("op") and n[2].isdigit() for n in bare.queries()) and "pipeline" not in bare.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
