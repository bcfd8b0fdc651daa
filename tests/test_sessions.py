import pytest

from brookline.errors import QueryError
from brookline.session import Session

OK = "OK returned_rows={} inserted_rows={} updated_rows={} deleted_rows={}\n"


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.define(
        """User { field(id, i64, notNull, primaryKey) field(name, string, notNull) field(email, string, nullable) field(active, bool, notNull, default, true) index(by_email, [email], unique)
        reference(posts, id, Post.user_id, withoutReferentialIntegrity) scope named |> where(name != "") |> sort(id asc) }
        Post { field(id, i64, notNull, primaryKey) field(user_id, i64, nullable) field(points, u8, notNull, default, 3) reference(author, user_id, User.id, withReferentialIntegrity(onDeleteCascade, onUpdateCascade)) }
        Note { field(id, i64, notNull, primaryKey) field(post_id, i64, nullable) reference(post, post_id, Post.id, withReferentialIntegrity(onDeleteSetNull, onUpdateRestrict)) }"""
    )
    assert s.run('User |> insert((id = 1, name = "Ann", email = "a"), (id = 2, name = "Bo"), (id = 3, name = "Cy", active = false)) {}') == OK.format(0, 3, 0, 0)
    s.run("Post |> insert((id = 10, user_id = 1), (id = 11, user_id = 1, points = 9), (id = 12, user_id = 2, points = 1)) {}")
    return s


def test_tree_with_limits_per_parent(s):
    out = s.run("User |> sort(id asc) { name posts |> sort(id desc) |> limit(1) { id points } active }")
    assert out == OK.format(3, 0, 0, 0) + '{name:str,posts:[{id:i64,points:u8}],active:bool}\n"Ann",[[11,9]],true\n"Bo",[[12,1]],true\n"Cy",[],false\n'


def test_constraints(s):
    assert "code=DuplicateKey" in s.run('User |> insert(id = 1, name = "x") {}')
    assert "code=DuplicateKey" in s.run('User |> insert((id = 7, name = "x"), (id = 7, name = "y")) {}')
    assert "code=DuplicateKey" in s.run('User |> insert(id = 8, name = "x", email = "a") {}')
    assert s.run('User |> insert((id = 8, name = "x"), (id = 9, name = "y")) {}') == OK.format(0, 2, 0, 0)  # null parts are exempt
    assert "code=ReferentialIntegrityViolation" in s.run("Post |> insert(id = 20, user_id = 99) {}")
    assert s.run("Post |> insert(id = 20, user_id = null) {}") == OK.format(0, 1, 0, 0)
    assert "code=NullNotAllowed" in s.run("User |> insert(id = 30) {}")
    assert "code=IntegerOutOfRange path=insert.points" in s.run("Post |> insert(id = 30, points = 256) {}")
    assert "code=TypeMismatch path=insert.active" in s.run('User |> insert(id = 31, name = "x", active = 1) {}')


def test_updates_and_actions(s):
    assert s.run("User |> where(id == 1) |> update(id = 5) { id name }") == OK.format(1, 0, 1, 0) + "5,Ann\n"
    assert s.run("Post |> where(user_id == 5) |> sort(id asc) { id }") == OK.format(2, 0, 0, 0) + "10\n11\n"
    s.run("Note |> insert((id = 1, post_id = 12), (id = 2, post_id = 10)) {}")
    assert "code=ReferentialIntegrityViolation" in s.run("Post |> where(id == 12) |> update(id = 13) {}")
    assert s.run("Post |> where(id == 12) |> delete { id }") == OK.format(1, 0, 0, 1) + "12\n"
    assert s.run("Note |> sort(id asc) { id post_id }") == OK.format(2, 0, 0, 0) + "1,null\n2,10\n"
    assert s.run("User |> where(id == 5) |> delete {}") == OK.format(0, 0, 0, 1)
    assert s.run("Post { id }") == OK.format(0, 0, 0, 0)


def test_assignments_see_earlier_ones(s):
    assert s.run("Post |> where(id == 11) |> update(points = points - 1, points = points * 2) { points }") == OK.format(1, 0, 1, 0) + "16\n"


def test_variables_and_requests(s):
    text = "let ids = User |> where(active == true) |> sort(id asc) { id }\nUser |> where(in(id, ids)) |> update(active = false) {}\nUser |> where(active == false) |> sort(id asc) |> limit(1) { id }"
    assert s.run(text) == OK.format(1, 0, 2, 0) + "1\n"
    assert s.run('let total = 2\n{ total: total, ok: true, labels: ["a", "b"] }') == OK.format(1, 0, 0, 0) + '{"total":2,"ok":true,"labels":["a","b"]}\n'
    assert s.run("let one = User |> where(id == 2) { id }\nUser |> where(in(id, one) || id == one) { name }") == OK.format(1, 0, 0, 0) + "Bo\n"
    assert "statement_index=1" in s.run("let a = 1\nlet a = 2\n1") and "code=DuplicateVariable" in s.run("let a = 1\nlet a = 2\n1")
    assert "code=AmbiguousIdentifier" in s.run("let id = 1\nUser |> where(id == 1) { name }")
    assert "code=MissingReturningBlock" in s.run("User |> where(id == 1)")


def test_errors_undo_the_request(s):
    assert s.run('User |> where(id == 3) |> delete {}\nUser |> insert(id = 1, name = "x") {}').startswith("ERR query: statement_index=1")
    assert s.run("User { n: count() }") == OK.format(1, 0, 0, 0) + "3\n"


def test_transactions(s):
    assert s.run("begin") == "OK BEGIN\n"
    s.run("User |> where(id == 3) |> delete {}")
    assert s.run("User |> insert(id = 1, name = \"x\") {}").startswith("ERR")  # doesn't end it
    assert s.run("User { n: count() }").endswith("2\n")
    s.run("ROLLBACK")
    assert s.run("User { n: count() }").endswith("3\n")
    s.run("BEGIN")
    s.run("User |> where(id == 3) |> delete {}")
    s.run("COMMIT")
    assert s.run("User { n: count() }").endswith("2\n")


def test_scopes_groups_and_inspect(s):
    assert s.run("User |> named |> limit(1) { name }") == OK.format(1, 0, 0, 0) + "Ann\n"
    assert s.run("Post |> group(user_id) |> having(sum(points) > 3) { user_id s: sum(points) avg(points) }") == OK.format(1, 0, 0, 0) + "1,12,6\n"
    assert "INSPECT plan" in s.run("Post |> where(points > 1) |> inspect { id }")
    assert "code=ScopeNotFound" in s.run("User |> other { id }")
    assert 'message="where expression must evaluate to boolean"' in s.run("User |> where(id + 1) { id }")


@pytest.mark.parametrize("text", [
    "A { field(id, i64) }", "A { field(id, i64, nullable, primaryKey) }", "A { field(id, i64, notNull, default, \"x\") }", "A { field(v, u8, notNull, default, 256) }", "A { field(id, i99, notNull) }", "A { field(id, i64, notNull) belongsTo A }",
    "A { field(id, i64, notNull, primaryKey) field(p, i32, nullable) reference(r, p, A.id, withReferentialIntegrity(onDeleteCascade, onUpdateCascade)) }", "A { field(id, i64, notNull, primaryKey) field(p, i64, notNull) reference(r, p, A.id, withReferentialIntegrity(onDeleteSetNull, onUpdateCascade)) }",
    "A { field(id, i64, notNull, primaryKey) field(p, i64, nullable) reference(r, p, A.id, withReferentialIntegrity(onDeleteSetDefault, onUpdateCascade)) }",
])
def test_bad_schemas(spark, text):
    with pytest.raises(QueryError):
        Session(spark).define(text)


@pytest.mark.parametrize("n", [4096, 4097])
def test_no_caps(spark, n):
    s = Session(spark)
    s.register("Big", spark.range(n), "id")
    assert s.query("Big |> where(id >= 0) { id }").count() == n
    assert s.query("Big |> group(id) { id n: count() }").count() == n
    assert [r.id for r in s.query("Big |> sort(id desc) |> offset(4090) |> limit(3) { id }").collect()] == [n - 4091, n - 4092, n - 4093]


def test_results_do_not_depend_on_partitions(spark):
    s = Session(spark)
    s.register("Big", spark.range(0, 500, 1, 7).selectExpr("id", "id % 7 as k"), "id")
    text = "Big |> group(k) |> sort(count() desc, k asc) { k n: count() s: sum(id) first: id }"
    want = s.query(text).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert s.query(text).collect() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream(spark, tmp_path):
    from brookline.streaming import pipelines

    spark.range(20).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
    pipelines.start(source, "M", "M |> where(k == 1) { id d: id * 2 }", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.d for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * i for i in range(20) if i % 3 == 1]
    with pytest.raises(QueryError):
        pipelines.stream(source, "M", "M |> sort(id asc) { id }")


def test_metrics_and_advice(s):
    s.run("User |> where(nothing == 1) { id }")
    last = s.metrics().orderBy("ts").collect()[-1]
    assert last.had_error and last.has_predicate and last.operation == "select" and last.total_ns > 0
    assert set(s.advise()) == {"queue_pressure", "spill_ratio", "low_selectivity", "latency_spikes"}
    assert s.run("inspect runtime --format json").startswith('{"parallelism"')


def test_advice_thresholds(spark):
    from brookline.operators import advisor

    rows = [(i, "select", True, False, i % 4 == 0, 0, 0, 100, 10 if i % 2 else 90, 2, 2, i // 6, 90_000_000 if i % 12 == 0 else 1_000_000) for i in range(40)]
    found = {k: rule(spark.createDataFrame(rows, advisor.SCHEMA)).first() for k, rule in advisor.RULES.items()}
    assert found["queue_pressure"].triggered and found["queue_pressure"].severity == "critical" and found["queue_pressure"].edges == 6
    assert found["spill_ratio"].triggered and found["spill_ratio"].spills == 10 and found["spill_ratio"].severity == "warning"
    assert (found["low_selectivity"].low, found["low_selectivity"].lowest_ppm) == (20, 100_000)
    assert (found["latency_spikes"].spikes, found["latency_spikes"].median_ns, found["latency_spikes"].threshold_ns) == (4, 1_000_000, 6_000_000)
    none = {k: rule(spark.createDataFrame([], advisor.SCHEMA)).first() for k, rule in advisor.RULES.items()}
    assert not none["queue_pressure"].triggered and none["latency_spikes"].samples == 0
