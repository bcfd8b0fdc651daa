import os

import pytest

from brookline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert normal(catalogue.QUERIES[name](spark, SF).toPandas()) == normal(duck.execute(catalogue.ORACLE_SQL[name]).df())


def test_plans(spark):
    """Filters and columns reach the scan, a sort with a limit is a top-k, and no Python runs."""
    plan = lambda q: catalogue.QUERIES[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan("pk_range") and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan("pk_range")
    assert "TakeOrderedAndProject" in plan("sort_limit_offset")
    assert "WindowGroupLimit" in plan("nested_topk")
    for q in catalogue.QUERIES:
        if not any(w in q for w in ("insert", "update", "delete", "fk_", "let_", "writes")):
            assert "Python" not in plan(q)
