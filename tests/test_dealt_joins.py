from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from brookline.operators import nested
from brookline.session import Session


def test_pairs_of_few_parents_are_dealt_over_tasks(spark):
    """Two parents with 2,500 and 10 rows of each of two relations: 6,250,101 rows, no task with more than half of them."""
    s = Session(spark)
    s.register("P", spark.range(3).withColumn("name", F.concat(F.lit("p"), "id")), "id")
    for name, column in (("A", "a"), ("B", "b")):
        s.register(name, spark.range(2510).select(F.col("id").alias(column), (F.col("id") < 10).cast("bigint").alias("p")), column)
        s.catalog.relate("P", f"{column}s", "id", name, "p")
    df = s.query("P { name as { a } bs { b } }")
    parts = df.groupBy("name", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()
    assert max(r.n for r in parts) <= 3_125_000
    whole = spark.range(2510).selectExpr("id as a").crossJoin(spark.range(2510).selectExpr("id as b")).where("(a < 10) = (b < 10)")
    want = whole.groupBy((F.col("a") < 10).alias("k")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()
    got = {p: (sum(r.n for r in parts if r.name == p), sum(r.h or 0 for r in parts if r.name == p)) for p in ("p0", "p1")}
    assert got == {"p1" if r.k else "p0": (r.n, r.h) for r in want} and [r.n for r in parts if r.name == "p2"] == [1]


@pytest.mark.parametrize(("kind", "cell"), [("bigint", 1), ("bigint", 1000), *[(k, 2) for k in ("bigint", "string", "boolean", "timestamp", "decimal(20,0)", "double")]])
def test_same_rows_however_pairs_are_dealt(spark, monkeypatch, kind, cell):
    """Null keys match, parents share keys, some have no children, children repeat; three relations."""
    monkeypatch.setattr(nested, "TASK_ROWS", 3)
    monkeypatch.setattr(nested, "CELL_ROWS", cell)
    parents = [(k, (0, 0, 1, None, None, 1, 0)[k]) for k in range(7)]
    kids = [(n % 3, (0, 0, 0, None, None, None)[n % 6]) for n in range(12)]
    others = [(n, n % 4) for n in range(9)]
    s = Session(spark)
    as_key = F.col("k").cast("int").cast(kind) if kind != "timestamp" else F.timestamp_seconds("k")
    s.register("P", spark.createDataFrame(parents, "id int, k int").withColumn("k", as_key), "id")
    s.register("C", spark.createDataFrame(kids, "c int, k int").withColumn("k", as_key))
    s.register("D", spark.createDataFrame(others, "d int, p bigint"))
    s.catalog.relate("P", "cs", "k", "C", "k")
    s.catalog.relate("P", "ds", "id", "D", "p")
    got = Counter(map(tuple, s.query("P { id cs { c } ds { d } more: id }").collect()))
    below = lambda key, rows: [v for v, k in rows if k == key] or [None]
    assert got == Counter((i, c, d, i) for i, k in parents for c, d in product(below(k, kids), below(i, others)))
    ordered = [tuple(r) for r in s.query("P |> sort(id desc) { id ds |> sort(d desc) |> limit(2) { d } cs |> unique |> sort(c asc) { c } }").collect()]
    top = {i: sorted(below(i, others), key=lambda x: -(x or 0))[:2] for i, _ in parents}
    assert ordered == [(i, d, c) for i, k in reversed(parents) for d, c in product(top[i], sorted(set(below(k, kids)), key=lambda x: x or 0))]


def test_keys_of_two_kinds_are_left_to_the_planner(spark, monkeypatch):
    """Keys of several texts may equal one number, so such a join isn't dealt."""
    monkeypatch.setattr(nested, "TASK_ROWS", 1)
    monkeypatch.setattr(nested, "CELL_ROWS", 1)
    s = Session(spark)
    s.register("P", spark.createDataFrame([(1, "1"), (2, "01"), (3, "1"), (4, "01")], "id int, k string"))
    s.register("C", spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "c int, k int"))
    s.catalog.relate("P", "cs", "k", "C", "k")
    assert Counter(map(tuple, s.query("P { id cs { c } }").collect())) == Counter(product((1, 2, 3, 4), (1, 2, 3)))
