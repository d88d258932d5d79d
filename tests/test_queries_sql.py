"""Every query with SQL gives the SQL's rows."""

import math
import os

import duckdb
import pytest

from corpusmill.plans import batch_queries, cluster_queries, file_queries, hierarchy_queries, more_queries, record_queries, retrieval_queries, text_queries, whole_table_queries  # noqa: F401
from corpusmill.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = QUERIES[name](spark, DATA)
    want = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = sorted(tuple(map(norm, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(norm, r)) for r in con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
