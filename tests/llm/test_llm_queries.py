"""Queries of the subpackage on the smallest tables, against their SQL where there is one."""

import pytest
from oracle import compare, connect

from parchline.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    if name in Q.ORACLE:
        assert compare(df, Q.ORACLE[name], connect(data)) == ""
    else:
        rows = df.collect()
        if name.endswith("_found"):
            assert len(rows) == len(set(map(tuple, rows)))
