"""Every registered query against its SQL on the smallest tables; those without SQL must run and keep their columns."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from parchline import queries_core, queries_data, queries_ledger, queries_pages, queries_search

MODULES = [queries_core, queries_data, queries_ledger, queries_pages, queries_search]
NAMES = [n for m in MODULES for n in m.QUERIES]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, con, name):
    sql = {k: v for m in MODULES for k, v in m.ORACLE.items()}.get(name)
    df = entry.queries()[name](spark, data)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, sql, con) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rest_stands_without_llm():
    import re
    from pathlib import Path

    root = Path(queries_core.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+parchline\.llm", p.read_text(), re.M), p
