"""The queries' SQL on a small corpus with nulls, copies and a line that many documents of a host share."""

import duckdb
import pytest
from test_operators import corpus

from brookline.llm import queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sql")
    rows = list({r[0]: r for r in corpus(5, 90)}.values())
    rows += [(10_000 + i, f"{'word%d ' % i * 60}\nshared  LINE of the host\nother{i}", "en", "h1", 1) for i in range(40)] + [(20_000 + i, f"a{i}\nshared line of the host\n" * 30, "en", "h1", 1) for i in range(5)]
    rows += [(30_000, "Released under the MIT License.\nx", "en", "h1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    text = lambda rows: sorted(tuple("" if x is None else str(x) for x in r) for r in rows)
    assert text(tuple(r[c] for c in columns) for r in got.collect()) == text(want.fetchall())
    if name == "op5_quality_rules":
        assert {r.doc_id for r in got.where("removed_words > 0").collect()} >= {10_000, 20_000}
