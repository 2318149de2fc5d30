import importlib

import pytest

import __spark_entry__ as entry


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["psm_id", "scan", "file_idx", "score", "fdr"] and out.count() >= 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_optional_package(monkeypatch):
    real = importlib.import_module

    def absent(name):
        if name.startswith(("peakweave.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name.rsplit(".", 1)[0] if "." in name else name)
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", absent)
    assert "fdr_prefix_cutoff" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert "fdr_prefix_cutoff" in entry.oracle_sql()


def test_other_import_errors_show(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError(name="something_else")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
