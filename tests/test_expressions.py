import itertools

import pytest

from brookline.errors import QueryError
from brookline.session import Session

TYPES = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "f64": "double", "bool": "boolean", "string": "string"}


@pytest.fixture(scope="module")
def s(spark):
    s = Session(spark)
    s.define(
        """T { field(id, i64, notNull, primaryKey) field(a, i64, nullable) field(b, i64, nullable) field(p, bool, nullable) field(q, bool, nullable) field(x, f64, nullable) field(s, string, nullable)
        field(tiny, i8, nullable) field(u, u64, nullable) field(v, u8, nullable) field(ts, timestamp, nullable) }"""
    )
    rows = [(1, 7, 2, True, None, 2.5, " É a ", -128, 18446744073709551615, 255, None), (2, None, 0, False, True, -1.0, None, 5, 1, 0, None), (3, -7, 2, None, False, 0.5, "zz", 127, 0, 7, None)]
    from decimal import Decimal

    rows = [(*r[:8], Decimal(r[8]), *r[9:]) for r in rows]
    s.load("T", spark.createDataFrame(rows, s.catalog.models["T"].spark_schema()))
    return s


def values(s, e):
    return [x.v for x in s.query(f"T |> sort(id asc) {{ v: {e} }}").collect()]


def ids(s, e):
    return [x.id for x in s.query(f"T |> where({e}) |> sort(id asc) {{ id }}").collect()]


@pytest.mark.parametrize(("e", "want"), [
    ("a == null", [False, True, False]), ("a != 7", [False, True, True]), ("a > 1", [True, None, False]), ("p && q", [None, False, False]), ("p || q", [True, True, None]), ("!q", [None, False, True]),
    ("in(a, [7, null])", [True, None, None]), ("in(b, [])", [False, False, False]), ("round(x)", [2.0, -1.0, 0.0]), ("length(s)", [6, None, 2]), ("upper(s)", [" É A ", None, "ZZ"]), ("trim(s)", ["É a", None, "zz"]), ("coalesce(a, b)", [7, 0, -7]),
    ("-v", [-255, 0, -7]), ("abs(b)", [2, 0, 2]), ("v + 1", [256, 1, 8]), ("b * 1.5", [3.0, 0.0, 3.0]), ("in(s, [\"zz\"])", [False, None, True]), ("q == p", [False, False, False]),
])
def test_values(s, e, want):
    assert values(s, e) == want


@pytest.mark.parametrize(("e", "want"), [
    ("a / b == 3", [1]), ("a / b == 0 - 3", [3]), ("a + 1 > 0", [1]), ("(1 / b) == null", []), ("p || 1 / b == 0", [1, 3]), ("q && 1 / b == 0", []), ("sqrt(x) > 0.0", [1, 3]), ("abs(tiny) > 0", [2, 3]), ("u + u > 0", [2]),
    ("tiny + tiny == 10", [2]), ("u > 1", [1]), ("v - 1 >= 0", [1, 3]), ("!(a > 1)", [3]), ("null == a", [2]), ("a == null || 1 / 0 == 1", [2]),
])
def test_predicate_errors_drop_rows(s, e, want):
    assert ids(s, e) == want


@pytest.mark.parametrize(("e", "code"), [("a + 1", "NullArithmeticOperand"), ("1 / b", "DivisionByZero"), ("sqrt(x)", "NumericDomain"), ("abs(tiny)", "IntegerOverflow"), ("u + u", "IntegerOverflow"), ("id * 9223372036854775807", "IntegerOverflow"), ("tiny * tiny", "IntegerOverflow")])
def test_projection_errors_abort(s, e, code):
    out = s.run(f"T |> sort(id asc) {{ v: {e} }}")
    assert out.startswith("ERR query:") and f"code={code}" in out


@pytest.mark.parametrize("e", ["s == 1", "s + 1", "!a", "lower(a)", "ts > 1", "in(s, [1])", "-s", "length(1)", "coalesce(s, 1)", "nothing(a)", "zzz"])
def test_types_are_checked(s, e):
    with pytest.raises(QueryError):
        s.query(f"T {{ v: {e} }}")


def test_same_expression_in_where_select_and_update(spark, s):
    for a, b in itertools.product(["a > 1", "p", "b == 2"], ["q", "x < 1.0"]):
        e = f"{a} && !({b}) || s == null"
        by_select = [i for i, v in enumerate(values(s, e), 1) if v]
        assert ids(s, e) == by_select
        other = Session(spark)
        other.define("T { field(id, i64, notNull, primaryKey) field(a, i64, nullable) field(b, i64, nullable) field(p, bool, nullable) field(q, bool, nullable) field(x, f64, nullable) field(s, string, nullable) field(hit, bool, nullable) }")
        frame = s.table("T").select("id", "a", "b", "p", "q", "x", "s").selectExpr("*", "cast(null as boolean) hit")
        other.load("T", frame)
        other.execute(f"T |> update(hit = {e}) {{}}")
        assert [r.id for r in other.query("T |> where(hit) |> sort(id asc) { id }").collect()] == by_select


def test_current_timestamp_is_one_per_request(s):
    found = s.execute("let a = CurrentTimestamp\n{ a: a, b: CurrentTimestamp }")
    assert isinstance(found.payload, dict)
    rows = s.query("T { v: CurrentTimestamp }").distinct().collect()
    assert len(rows) == 1


def test_parameters(s):
    assert [r.id for r in s.query("T |> where(a == $x) { id }", {"$x": 7}).collect()] == [1]
    assert "code=UndefinedParameter" in s.run("T |> where(a == $y) { id }")
