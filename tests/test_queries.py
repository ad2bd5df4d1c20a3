import importlib.util

import pytest

import oracle
from stratalith.plans import layout_queries, registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, DATA, registry.QUERIES[name], registry.ORACLES[name])


def test_entry_imports_without_the_corpus_folders(monkeypatch):
    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name, *a: None if name.startswith("stratalith.llm") or name == "corpus_pipeline" else find(name, *a))
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert not entry.entry(spark).isEmpty()


def test_queries_without_sql(spark):
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"html_export", "authoring_roundtrip", "merged_tables"}
    assert layout_queries.authoring_roundtrip(spark, DATA).where("not equal").isEmpty()
    assert layout_queries.merged_tables(spark, DATA).where("not equal").isEmpty()
    assert layout_queries.html_export(spark, DATA).where("n_chars < 100").isEmpty()
