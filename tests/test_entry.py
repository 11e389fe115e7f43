import importlib
import sys

import pytest


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", ["corpus_pipeline", "spanlake.llm"])
def test_library_works_without_the_corpus_operators(monkeypatch, gone):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == gone:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m in ("corpus_pipeline", "__spark_entry__") or m.startswith("spanlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import spanlake

    monkeypatch.delattr(spanlake, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    assert "evidence_map" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
