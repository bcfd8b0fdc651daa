"""Frames: a DataFrame with typed columns and what later operators of its pipeline need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Scope, Value, compile_expression
from ..functions.types import NUMERIC, SPARK
from ..errors import QueryError
from .nodes import Call, Expr, Op, Selection, walk
from .parser import AGGREGATES

#: The source order of rows; only made where an operator depends on it.
ORDER = "__order"


@dataclass
class Variable:
    """A request's variable: one value, or the values of a one-column frame."""

    frame: DataFrame | None
    type: str
    scalar: object = None
    is_scalar: bool = False
    has_null: bool = False


@dataclass
class Frame:
    df: DataFrame
    #: Column name -> (column of df, type).
    columns: dict[str, tuple[str, str]]
    #: Aggregates by their text, once grouped: (column of df, type).
    aggregates: dict[str, tuple[str, str]] | None = None
    #: The current order, as columns for orderBy.
    order: list[Column] = field(default_factory=list)

    def scope(self, context: Context) -> Scope:
        out = Scope({k: (F.col(f"`{c}`"), t) for k, (c, t) in self.columns.items()}, context.variables, context.params, context.now)
        if self.aggregates is not None:
            out.aggregate = lambda call: (F.col(f"`{self.aggregates[key(call)][0]}`"), self.aggregates[key(call)][1])
        return out


@dataclass
class Context:
    """What all statements of a request share."""

    variables: dict[str, object] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)
    now: int = 0


def key(e: Expr) -> str:
    """The text of an expression, whatever its positions."""
    parts = [type(e).__name__, *(str(getattr(e, a)) for a in ("name", "op", "value", "star") if hasattr(e, a))]
    below = [x for x in (getattr(e, "operand", None), getattr(e, "left", None), getattr(e, "right", None)) if x is not None]
    below += [x[1] if isinstance(x, tuple) else x for x in [*getattr(e, "args", ()), *getattr(e, "items", ())]]
    return f"{':'.join(parts)}({','.join(map(key, below))})"


def aggregate_calls(ops: list[Op], selection: Selection | None) -> dict[str, Call]:
    """The aggregates that operators after a group and the selection use."""
    found: dict[str, Call] = {}
    exprs = [op.expr for op in ops if op.kind == "having"] + [k.expr for op in ops if op.kind == "sort" for k in op.keys]
    exprs += [f.expr for f in selection.fields if f.nested is None] if selection else []
    for e in exprs:
        for x in walk(e):
            if isinstance(x, Call) and x.name in AGGREGATES:
                found[key(x)] = x
    return found


def aggregate(call: Call, scope: Scope) -> tuple[Column, str]:
    """The aggregation of a call and its type. Nulls don't count; nothing left gives null."""
    if call.name == "count":
        if call.args:
            raise QueryError("count aggregate shape unsupported", "QueryExecutionError", "execution", "query", *call.pos)
        return F.count(F.lit(1)), "i64"
    if len(call.args) != 1 or call.star:
        raise QueryError("aggregate evaluation failed", "QueryExecutionError", "execution", "query", *call.pos)
    v: Value = compile_expression(call.args[0], scope)
    column = v.column
    if v.error is not None:
        column = F.when(v.error.isNull(), column).otherwise(F.raise_error(F.concat(F.lit("QERR:"), v.error, F.lit(":"))).cast(SPARK[v.type]))
    if call.name in ("min", "max"):
        if v.type == "null":
            return F.lit(None), "null"
        return (F.min if call.name == "min" else F.max)(column), v.type
    if v.type not in NUMERIC:
        raise QueryError("aggregate evaluation failed", "QueryExecutionError", "execution", "query", *call.pos)
    if call.name == "avg":
        return F.avg(column.cast("double")), "f64"
    if v.type == "f64":
        return F.sum(column), "f64"
    # Sums of integers are signed 64-bit integers; beyond, the request fails (ANSI).
    return F.sum(column.cast("decimal(20,0)") if v.type == "u64" else column.cast("bigint")).cast("bigint"), "i64"
