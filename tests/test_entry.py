import importlib

import pytest


def test_contract(spark):
    e = importlib.import_module("__spark_entry__")
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["dsl_filter_basic", "writer_tags", "interval_enclosing", "regex_exclusive", "scope_fqn"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os
    from collections import Counter

    e = importlib.import_module("__spark_entry__")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = e.queries()[name](spark, d)
    r = con.execute(e.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert Counter(tuple(x) for x in r.fetchall()) == Counter(tuple(x[c] for c in cols) for x in df.collect())
