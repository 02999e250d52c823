import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillfold.plans import queries as core

DATA = "/root/testdata/sf0.001"


def test_every_query_with_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.SQL) <= set(core.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["tokenize_docs", "clean_text", "bm25_topk", "acl_filter", "relevance_gate", "latency_summary"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(core.SQL[name])
    columns = [c[0] for c in want.description]
    got = core.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
