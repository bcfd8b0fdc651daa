"""Compilation of typed expressions to columns.

Each expression becomes a value and an error: the error column holds a code where evaluating the row fails, and is None
where it cannot. Errors stay apart from values because null-safe equality and coalesce would otherwise take a failed
value for a null one. Where a predicate fails, its row doesn't match; elsewhere the request fails. Types are checked
while compiling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.nodes import Binary, Call, Expr, ListOf, Literal, Name, Now, Param, Unary
from ..plans.parser import AGGREGATES
from . import scalar
from .types import INTEGERS, NUMERIC, SPARK, UNSIGNED, arithmetic, comparable, literal_type


@dataclass
class Value:
    column: Column
    type: str
    error: Column | None = None


def first_error(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def mismatch(pos: tuple[int, int], what: str = "operand types don't fit") -> QueryError:
    return QueryError(what, "TypeMismatch", "execution", "query", *pos)


@dataclass
class Scope:
    """What names mean in an expression."""

    columns: dict[str, tuple[Column, str]] = field(default_factory=dict)
    variables: dict[str, object] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)
    now: int = 0
    #: Gives the column and type of an aggregate call, where there are groups.
    aggregate: Callable[[Call], tuple[Column, str]] | None = None
    #: Gives the three-valued membership of a value in a list variable.
    member: Callable[[Value, str, tuple[int, int]], Column] | None = None


def literal(value: object) -> Value:
    kind = literal_type(value)
    if kind == "null":
        return Value(F.lit(None), kind)
    if kind == "u64":
        return Value(F.lit(str(value)).cast("decimal(20,0)"), kind)
    return Value(F.lit(value).cast(SPARK[kind]), kind)


def compile_expression(e: Expr, scope: Scope) -> Value:
    if isinstance(e, Literal):
        return literal(e.value)
    if isinstance(e, Now):
        return Value(F.timestamp_micros(F.lit(scope.now)), "timestamp")
    if isinstance(e, Param):
        if e.name not in scope.params:
            raise QueryError("undefined parameter", "UndefinedParameter", "execution", "query", *e.pos)
        return literal(scope.params[e.name])
    if isinstance(e, Name):
        return _name(e, scope)
    if isinstance(e, Unary):
        return _unary(e, scope)
    if isinstance(e, Binary):
        return _binary(e, scope)
    if isinstance(e, Call):
        return _call(e, scope)
    raise mismatch(e.pos, "a list or object can't stand here")


def _name(e: Name, scope: Scope) -> Value:
    known, variable = e.name in scope.columns, e.name in scope.variables
    if known and variable:
        raise QueryError(f"{e.name} is a column and a variable", "AmbiguousIdentifier", "execution", "query", *e.pos)
    if known:
        return Value(*scope.columns[e.name])
    if not variable:
        raise QueryError(f"unknown column or variable {e.name}", "ColumnNotFound", "execution", "query", *e.pos)
    value = scope.variables[e.name]
    if hasattr(value, "scalar"):
        if not value.is_scalar:
            raise QueryError(f"{e.name} is a list", "VariableTypeMismatch", "execution", "query", *e.pos)
        return Value(literal(value.scalar).column.cast(SPARK[value.type]) if value.scalar is not None else F.lit(None).cast(SPARK[value.type]), value.type)
    return literal(value)


def _ranged(raw: Column, kind: str, inputs: tuple[Column, ...], more: Column | None = None) -> tuple[Column, Column]:
    """(value, error) of an integer result that was computed in a wider type, null where that one overflowed."""
    low, high = INTEGERS[kind]
    outside = raw.isNull() if kind == "i64" else raw.isNull() | ~raw.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)")) if kind == "u64" else raw.isNull() | ~raw.between(low, high)
    null = inputs[0].isNull()
    for x in inputs[1:]:
        null = null | x.isNull()
    error = F.when(null, "NullArithmeticOperand")
    if more is not None:
        error = error.when(more, "DivisionByZero")
    error = error.when(outside, "IntegerOverflow")
    return F.when(~outside, raw).cast(SPARK[kind]), error


def _arithmetic(op: str, a: Value, b: Value, pos: tuple[int, int]) -> Value:
    if "null" in (a.type, b.type):
        other = b.type if a.type == "null" else a.type
        if other not in {*NUMERIC, "null"}:
            raise mismatch(pos)
        return Value(F.lit(None).cast("bigint"), "i64", first_error(a.error, b.error, F.lit("NullArithmeticOperand")))
    kind = arithmetic(a.type, b.type)
    if kind is None:
        raise mismatch(pos)
    if kind == "f64":
        x, y = a.column.cast("double"), b.column.cast("double")
        error = F.when(x.isNull() | y.isNull(), "NullArithmeticOperand")
        if op == "/":
            error, value = error.when(y == 0, "DivisionByZero"), F.when(y != 0, x / y)
        else:
            value = {"+": x + y, "-": x - y, "*": x * y}[op]
        return Value(value, kind, first_error(a.error, b.error, error))
    wide = "decimal(20,0)" if kind == "u64" else "bigint"
    x, y = a.column.cast(wide), b.column.cast(wide)
    if op == "/":
        safe = F.when(y != 0, y)
        if wide == "bigint":
            safe = F.when((y != 0) & ~((y == -1) & (x == F.lit(-(2**63)))), y)
            raw = F.call_function("div", x, safe)
        else:
            raw = ((x - x % safe) / safe).cast(wide)
        value, error = _ranged(raw, kind, (x, y), y == 0)
    else:
        raw = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        value, error = _ranged(raw, kind, (x, y))
    return Value(value, kind, first_error(a.error, b.error, error))


def _compare(op: str, a: Value, b: Value, pos: tuple[int, int]) -> Value:
    if not comparable(a.type, b.type):
        raise mismatch(pos, "values of these types can't be compared")
    x, y = a.column, b.column
    if a.type != b.type and "null" not in (a.type, b.type):
        if "f64" in (a.type, b.type):
            x, y = x.cast("double"), y.cast("double")
        elif "u64" in (a.type, b.type):
            x, y = x.cast("decimal(20,0)"), y.cast("decimal(20,0)")
    if op in ("==", "!="):
        same = x.eqNullSafe(y)
        column = same if op == "==" else ~same
    else:
        column = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Value(column, "bool", first_error(a.error, b.error))


def _truth(v: Value) -> Column:
    """A value as an operand of && and ||: what isn't boolean counts as null."""
    return v.column if v.type == "bool" else F.lit(None).cast("boolean")


def _binary(e: Binary, scope: Scope) -> Value:
    a, b = compile_expression(e.left, scope), compile_expression(e.right, scope)
    if e.op in "+-*/":
        return _arithmetic(e.op, a, b, e.pos)
    if e.op not in ("&&", "||"):
        return _compare(e.op, a, b, e.pos)
    x, y = _truth(a), _truth(b)
    # The right side is not evaluated, so it can't fail, where the left one decides.
    decided = ~F.coalesce(x, F.lit(True)) if e.op == "&&" else F.coalesce(x, F.lit(False))
    right = None if b.error is None else F.when(~decided, b.error)
    return Value(x & y if e.op == "&&" else x | y, "bool", first_error(a.error, right))


def _unary(e: Unary, scope: Scope) -> Value:
    v = compile_expression(e.operand, scope)
    if e.op == "!":
        if v.type not in ("bool", "null"):
            raise mismatch(e.pos)
        return Value(~v.column.cast("boolean"), "bool", v.error)
    if v.type == "null":
        return v
    if v.type not in NUMERIC:
        raise mismatch(e.pos)
    if v.type == "f64":
        return Value(-v.column, "f64", v.error)
    kind = "i64" if v.type in UNSIGNED else v.type
    low, high = INTEGERS[kind]
    wide = v.column.cast("decimal(38,0)") * -1
    outside = ~wide.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)"))
    return Value(F.when(~outside, wide).cast(SPARK[kind]), kind, first_error(v.error, F.when(outside, "IntegerOverflow")))


def _call(e: Call, scope: Scope) -> Value:
    if e.name in AGGREGATES:
        if scope.aggregate is None:
            raise QueryError(f"{e.name}() needs groups", "UnknownFunction", "execution", "query", *e.pos)
        return Value(*scope.aggregate(e))
    if e.name == "in":
        return _member(e, scope)
    args = [compile_expression(a, scope) for a in e.args]
    if e.name not in scalar.FUNCTIONS:
        raise QueryError(f"unknown function {e.name}", "UnknownFunction", "execution", "query", *e.pos)
    column, kind, error = scalar.FUNCTIONS[e.name](e.pos, [(a.column, a.type) for a in args])
    return Value(column, kind, first_error(*[a.error for a in args], error))


def _member(e: Call, scope: Scope) -> Value:
    needle = compile_expression(e.args[0], scope)
    group = e.args[1]
    if isinstance(group, ListOf):
        items = [compile_expression(x, scope) for x in group.items]
        for x in items:
            if not comparable(needle.type, x.type):
                raise mismatch(e.pos)
        error = first_error(needle.error, *[x.error for x in items])
        if not items:
            return Value(F.when(needle.column.isNotNull(), False), "bool", error)
        return Value(needle.column.isin(*[x.column for x in items]), "bool", error)
    if isinstance(group, Name):
        if group.name in scope.columns:
            raise QueryError(f"{group.name} is a column, not a list", "VariableTypeMismatch", "execution", "query", *group.pos)
        if group.name not in scope.variables:
            raise QueryError(f"undefined variable {group.name}", "UndefinedVariable", "execution", "query", *group.pos)
        if scope.member is None:
            raise QueryError("membership in a variable can't be tested here", "VariableTypeMismatch", "execution", "query", *group.pos)
        return Value(scope.member(needle, group.name, e.pos), "bool", needle.error)
    raise mismatch(e.pos, "the second argument of in() is a list or a variable")


def checked(v: Value) -> Column:
    """The value; rows where it fails end the request."""
    if v.error is None:
        return v.column
    return F.when(v.error.isNull(), v.column).otherwise(F.raise_error(F.concat(F.lit("QERR:"), v.error, F.lit(":"))).cast(SPARK[v.type] if v.type != "null" else "string"))


def matches(v: Value, what: str, pos: tuple[int, int]) -> Column:
    """A predicate for a filter: rows where it is null or fails don't match. Kept plain, so that it reaches the scan."""
    if v.type not in ("bool", "null"):
        raise QueryError(f"{what} expression must evaluate to boolean", "QueryExecutionError")
    kept = v.column if v.type == "bool" else F.lit(False)
    return kept if v.error is None else kept & v.error.isNull()
