"""The driver's contract."""

import importlib.util
import os

import pytest

import __spark_entry__ as entry

CORPUS = importlib.util.find_spec("lattiq.llm") is not None and importlib.util.find_spec("lattiq.llm.queries") is not None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_corpus_queries_are_there_with_their_package():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == (list(range(1, 11)) if CORPUS else [])
    assert ("pipeline" in entry.queries()) == (CORPUS and importlib.util.find_spec("corpus_pipeline") is not None)


def test_core_queries_need_none_of_the_corpus_libraries(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("lattiq.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    names = entry.queries()
    assert "knn_exact" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "nbr", "rank", "d2"]


def test_nothing_else_imports_the_corpus_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "lattiq")):
        if os.path.basename(folder) != "llm":
            assert not any("lattiq.llm" in open(os.path.join(folder, n)).read() for n in names if n.endswith(".py"))
