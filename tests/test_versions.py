import os

from brookline.session import Session


def versions(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {x for x in os.listdir(folder) if x.startswith("version-")}


def test_vacuum_keeps_what_tables_read(spark):
    before, s = versions(spark), Session(spark)
    s.define("A { field(id, i64, notNull, primaryKey) field(n, i64, nullable) reference(same, n, A.n, withoutReferentialIntegrity) }")
    s.run("A |> insert((id = 1, n = 5), (id = 2), (id = 3)) {}")
    s.run("A |> where(id == 3) |> delete {}")
    s.run("let ids = A |> where(n == 5) { id }\nA |> where(in(id, ids)) |> update(n = 6) {}")
    assert len(versions(spark) - before) == 4 and s.vacuum() == 3 and s.vacuum() == 0
    assert len(versions(spark) - before) == 1
    assert s.run("A |> sort(id asc) { id n }").split("\n")[1:3] == ["1,6", "2,null"]
    # A rolled-back change leaves its version to the next vacuum; the committed one stays.
    s.run("BEGIN")
    s.run("A |> delete {}")
    assert s.vacuum() == 0
    s.run("ROLLBACK")
    assert s.vacuum() == 1 and s.run("A { n: count() }").split("\n")[1] == "2"


def test_null_keys_match_where_both_sides_may_be_null(spark):
    s = Session(spark)
    s.define("""P { field(id, i64, notNull, primaryKey) field(k, i64, nullable) reference(kids, k, C.k, withoutReferentialIntegrity) reference(own, id, C.k, withoutReferentialIntegrity) }
                C { field(id, i64, notNull, primaryKey) field(k, i64, nullable) }""")
    s.run("P |> insert((id = 1, k = 7), (id = 2)) {} C |> insert((id = 10, k = 7), (id = 11), (id = 12, k = 1)) {}")
    assert sorted(map(tuple, s.query("P { id kids { id } }").collect())) == [(1, 10), (2, 11)]
    own = s.query("P { id own { id } }")
    assert {tuple(r) for r in own.collect()} == {(1, 12), (2, None)}
    assert "<=>" not in own._jdf.queryExecution().analyzed().toString()
