"""Operators on the rows of one frame: where, having, sort, limit, offset, unique, group."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.expressions import Value, checked, compile_expression, literal, matches
from ..functions.types import INTEGERS, comparable
from ..plans.frames import ORDER, Context, Frame, Variable, aggregate, aggregate_calls
from ..plans.nodes import Call, Expr, Literal, Name, Op, Selection, Unary, walk
from ..plans.parser import AGGREGATES


def ordered_source(frame: Frame) -> Frame:
    """With the source order as a column: partition and row within."""
    if ORDER in frame.df.columns:
        return frame
    return replace(frame, df=frame.df.withColumn(ORDER, F.monotonically_increasing_id()))


def conjuncts(e: Expr) -> list[Expr]:
    return [*conjuncts(e.left), *conjuncts(e.right)] if getattr(e, "op", None) == "&&" else [e]


def keep(frame: Frame, op: Op, context: Context) -> Frame:
    """where and having: rows whose predicate is true; null and failing predicates don't match."""
    if op.kind == "where" and any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(op.expr)):
        raise QueryError("where can't use aggregates; use having", "QueryExecutionError", "execution", "query", *op.pos)
    parts, rest = conjuncts(op.expr), []
    for part in parts:
        semi = _membership(frame, part, context)
        if semi is None:
            rest.append(part)
        else:
            frame = semi
    if len(rest) == len(parts):
        return _filtered(frame, op, op.expr, context)
    for part in rest:  # a conjunction is true where each part is
        frame = _filtered(frame, op, part, context)
    return frame


def _filtered(frame: Frame, op: Op, e: Expr, context: Context) -> Frame:
    flagged, scope = with_members(frame, e, context)
    kept = flagged.df.where(matches(compile_expression(e, scope), op.kind, op.pos))
    return replace(frame, df=kept.select(*frame.df.columns) if flagged is not frame else kept)


def _variable(e: Expr, context: Context) -> Variable | None:
    if isinstance(e, Call) and e.name == "in" and len(e.args) == 2 and isinstance(e.args[1], Name):
        v = context.variables.get(e.args[1].name)
        return v if isinstance(v, Variable) and v.frame is not None else None
    return None


def _membership(frame: Frame, e: Expr, context: Context) -> Frame | None:
    """``in(x, list)`` as a semi join, ``!in(x, list)`` as a null-aware anti join, where they stand alone."""
    negated = isinstance(e, Unary) and e.op == "!"
    call = e.operand if negated else e
    variable = _variable(call, context)
    if variable is None or call.args[1].name in frame.columns:
        return None
    needle = compile_expression(call.args[0], frame.scope(context))
    _same_kind(needle, variable, call)
    if needle.error is not None:
        return None
    if negated and variable.has_null:
        return replace(frame, df=frame.df.where(F.lit(False)))
    values = variable.frame.select(F.col(variable.frame.columns[0]).alias("__v")).where("__v is not null")
    df = frame.df.where(needle.column.isNotNull())
    return replace(frame, df=df.join(values, needle.column == F.col("__v"), "left_anti" if negated else "left_semi"))


def _same_kind(needle: Value, variable: Variable, call: Call) -> None:
    if not comparable(needle.type, variable.type):
        raise QueryError("values of these types can't be compared", "TypeMismatch", "execution", "query", *call.pos)


def with_members(frame: Frame, e: Expr | None, context: Context):
    """(frame, scope) in which memberships in list variables are columns: a left join to each list's distinct values."""
    scope = frame.scope(context)
    calls = [x for x in walk(e) if _variable(x, context) is not None] if e is not None else []
    flags: dict[int, Column] = {}
    out = frame
    for k, call in enumerate(calls):
        variable = _variable(call, context)
        needle = compile_expression(call.args[0], scope)
        _same_kind(needle, variable, call)
        values = variable.frame.select(F.col(variable.frame.columns[0]).alias(f"__v{k}")).where(f"__v{k} is not null").distinct().withColumn(f"__in{k}", F.lit(True))
        out = replace(out, df=out.df.join(values, needle.column == F.col(f"__v{k}"), "left"))
        found = F.when(needle.column.isNull(), F.lit(None)).when(F.col(f"__in{k}"), F.lit(True))
        flags[id(call)] = found if variable.has_null else found.otherwise(F.lit(False))
    if calls:
        positions = {(c.args[1].name, c.pos): flags[id(c)] for c in calls}
        scope.member = lambda needle, name, pos: positions[(name, pos)]
    else:
        scope.member = lambda needle, name, pos: _scalar_member(needle, context.variables[name], pos)
    return out, scope


def _scalar_member(needle: Value, value: object, pos: tuple[int, int]) -> Column:
    """A variable of one value is a list of one."""
    if isinstance(value, list):
        return needle.column.isin(*[literal(x).column for x in value]) if value else F.when(needle.column.isNotNull(), False)
    v = literal(value.scalar if isinstance(value, Variable) else value)
    return needle.column.isin(v.column)


def sort(frame: Frame, op: Op, context: Context) -> Frame:
    """Stable: rows with equal keys keep their order. Nulls are last ascending, first descending."""
    keys = sort_columns(frame, op, context)
    frame = replace(frame, order=[*keys, *frame.order])
    return replace(frame, df=frame.df.orderBy(*frame.order, *([F.col(ORDER)] if ORDER in frame.df.columns else [])))


def sort_columns(frame: Frame, op: Op, context: Context) -> list[Column]:
    out = []
    for k in op.keys:
        column = checked(compile_expression(k.expr, frame.scope(context)))
        out.append(column.desc_nulls_first() if k.descending else column.asc_nulls_last())
    return out


#: The most rows that Spark's own limit and offset take.
MOST_ROWS = 2**31 - 1


def bound(op: Op, context: Context) -> int | None:
    """The number of a limit or offset, an expression without columns.

    None where it fails or isn't an integer: then the operator has no effect.
    """
    e = op.expr
    if isinstance(e, Literal):
        value = e.value
    else:
        one = Frame(SparkSession.active().range(1), {})
        try:
            _, scope = with_members(one, e, context)
            v = compile_expression(e, scope)
        except QueryError:
            return None
        if v.type not in INTEGERS:
            return None
        value = one.df.select(v.column if v.error is None else F.when(v.error.isNull(), v.column)).first()[0]
        value = None if value is None else int(value)
    return max(0, value) if isinstance(value, int) and not isinstance(value, bool) else None


def limited(frame: Frame, kind: str, n: int) -> Frame:
    """The first n rows, or those after them. A limit beyond Spark's range takes all rows; an offset is counted by rank."""
    if kind == "limit":
        return replace(frame, df=frame.df.limit(n)) if n <= MOST_ROWS else frame
    if n <= MOST_ROWS:
        return replace(frame, df=frame.df.offset(n))
    order = [*frame.order, *([F.col(ORDER)] if ORDER in frame.df.columns else [])] or [F.lit(0)]
    ranked = frame.df.withColumn("__rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return replace(frame, df=ranked.where(F.col("__rank") > n).drop("__rank"))


def group(frame: Frame, op: Op, later: list[Op], selection: Selection | None, context: Context, extra: tuple[str, ...] = ()) -> Frame:
    """Groups by columns. Aggregates that later operators use are computed here, once.

    Other columns that are used later are those of the group's first row in source order. ``extra`` are columns that
    are kept as keys besides (a parent's key).
    """
    names = list(op.names)
    if not names:
        raise QueryError("group needs a column", "QueryExecutionError", "execution", "query", *op.pos)
    for n in names:
        if n not in frame.columns:
            raise QueryError(f"unknown column {n}", "ColumnNotFound", "execution", "query", *op.pos)
    scope, calls = frame.scope(context), aggregate_calls(later, selection)
    aggregates, parts = {}, []
    for k, (text, call) in enumerate(calls.items()):
        column, kind = aggregate(call, scope)
        aggregates[text] = (f"__agg{k}", kind)
        parts.append(column.alias(f"__agg{k}"))
    used = {x.name for o in later if o.kind in ("having", "sort") for e in [o.expr, *[k.expr for k in o.keys]] for x in _outside_aggregates(e)}
    used |= {n for f in (selection.fields if selection else []) if f.nested is None for n in ([f.name] if f.expr is None else [x.name for x in _outside_aggregates(f.expr)])}
    used |= set(frame.columns) if selection is not None and not selection.fields else set()
    first = [n for n in frame.columns if n in used and n not in names]
    if first:
        frame = ordered_source(frame)
        parts += [F.min_by(F.col(f"`{frame.columns[n][0]}`"), F.col(ORDER)).alias(frame.columns[n][0]) for n in first]
    if ORDER in frame.df.columns:
        parts.append(F.min(ORDER).alias(ORDER))
    keys = [F.col(f"`{frame.columns[n][0]}`") for n in names] + [F.col(x) for x in extra]
    grouped = frame.df.groupBy(*keys)
    df = grouped.agg(*parts) if parts else frame.df.select(*keys).distinct()
    return Frame(df, {n: frame.columns[n] for n in frame.columns if n in names or n in first}, aggregates)


def _outside_aggregates(e: Expr | None) -> list[Name]:
    if e is None or isinstance(e, Call) and e.name in AGGREGATES:
        return []
    if isinstance(e, Name):
        return [e]
    return [n for x in [getattr(e, "operand", None), getattr(e, "left", None), getattr(e, "right", None), *getattr(e, "args", ())] for n in _outside_aggregates(x)]
