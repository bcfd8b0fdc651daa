"""From a read pipeline to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.expressions import checked, compile_expression
from ..operators import nested, rows
from ..sources.catalog import Catalog, Model
from .frames import ORDER, Context, Frame, aggregate, aggregate_calls
from .nodes import Field, Name, Op, Pipeline, Selection


@dataclass
class Result:
    """A pipeline's rows. fields: (name, type or, for a tree, the list of child fields)."""

    df: DataFrame
    fields: list[tuple[str, object]]
    tree: bool = False
    inspect: bool = False


@dataclass
class Compiler:
    catalog: Catalog
    table: Callable[[str], DataFrame]
    context: Context = field(default_factory=Context)

    def source(self, model: Model) -> Frame:
        df = self.table(model.name)
        return Frame(df.select(*model.columns), {c.name: (c.name, c.type) for c in model.columns.values()})

    def expanded(self, model: Model, ops: list[Op], seen: tuple[str, ...] = ()) -> list[Op]:
        """Scopes replaced by their operators."""
        out: list[Op] = []
        for op in ops:
            if op.kind != "scope":
                out.append(op)
            elif op.names[0] not in model.scopes or op.names[0] in seen:
                raise QueryError(f"unknown scope {op.names[0]}", "ScopeNotFound", "execution", "query", *op.pos)
            else:
                out += self.expanded(model, model.scopes[op.names[0]], (*seen, op.names[0]))
        return out

    def read(self, p: Pipeline, flat: bool = False) -> Result:
        """``flat``: children as columns of joined rows instead of a list."""
        model = self.catalog.model(p.model, p.pos)
        ops = self.expanded(model, p.ops)
        frame = self.source(model)
        # A top-level where filters the source, wherever it stands.
        for op in ops:
            if op.kind == "where":
                frame = rows.keep(frame, op, self.context)
        ops = [op for op in ops if op.kind != "where"]
        if any(op.kind == "sort" for op in ops):
            frame = rows.ordered_source(frame)
        inspect = False
        for k, op in enumerate(ops):
            if op.kind == "having":
                frame = rows.keep(frame, op, self.context)
            elif op.kind == "group":
                frame = rows.group(frame, op, ops[k + 1 :], p.selection, self.context)
            elif op.kind == "sort":
                frame = rows.sort(frame, op, self.context)
            elif op.kind in ("limit", "offset"):
                n = rows.bound(op, self.context)
                if n is not None:
                    frame = rows.limited(frame, op.kind, n)
            elif op.kind == "unique":
                frame = self._unique(frame, ops[k + 1 :], p.selection)
            elif op.kind == "inspect":
                inspect = True
            else:
                raise QueryError(f"{op.kind} can't stand in a read", "QueryExecutionError", "execution", "query", *op.pos)
        result = self.project(frame, model, p.selection, flat)
        result.inspect = inspect
        return result

    def _unique(self, frame: Frame, later: list[Op], selection: Selection | None) -> Frame:
        """Distinct rows of the columns that the selection and later operators use."""
        used = {f.name for f in selection.fields if f.expr is None and f.nested is None} if selection else set()
        used |= {n.name for f in (selection.fields if selection else []) if f.expr is not None for n in rows._outside_aggregates(f.expr)}
        used |= {n.name for o in later for e in [o.expr, *[k.expr for k in o.keys]] for n in rows._outside_aggregates(e)}
        names = [n for n in frame.columns if n in used] or list(frame.columns)
        df = frame.df.select(*[frame.columns[n][0] for n in names]).distinct()
        return Frame(df, {n: frame.columns[n] for n in names})

    def project(self, frame: Frame, model: Model, selection: Selection | None, flat: bool = False) -> Result:
        fields = (selection.fields if selection else None) or [Field((1, 1), n) for n in frame.columns]
        below = [f for f in fields if f.nested is not None]
        if frame.aggregates is None and not below and self._global(fields):
            return self._global_aggregate(frame, fields)
        tree = len(below) == 1 and not flat
        children: dict[int, tuple[Frame, list[tuple[str, str]]]] = {}
        steps = []
        for f in below:
            relation = model.relations.get(f.name)
            if relation is None:
                raise QueryError(f"unknown relation {f.name}", "AssociationNotFound", "execution", "query", *f.pos)
            target = self.catalog.model(relation.target, f.pos)
            ops = self.expanded(target, f.ops)
            child, names = nested.children(self.source(target), relation.target_column, replace(f, ops=ops), self.context)
            if relation.local not in frame.columns:
                raise QueryError(f"relation {f.name} needs column {relation.local}", "ColumnNotFound", "execution", "query", *f.pos)
            nullable = model.columns[relation.local].nullable and target.columns[relation.target_column].nullable
            steps.append((relation.local, child, nullable, model.columns[relation.local].primary, target.columns[relation.target_column].primary))
            children[id(f)] = child, names
        dealt = nested.deals(frame, steps) if steps and not tree else []
        if any(dealt):
            frame = replace(frame, df=frame.df.withColumn(nested.ROW, F.monotonically_increasing_id()))
        for k, (f, (local, child, nullable, *_)) in enumerate(zip(below, steps, strict=True)):
            frame = nested.joined_tree(frame, local, child, children[id(f)][1], f.name, nullable) if tree else nested.joined_flat(frame, local, child, f"r{k}", nullable, dealt[k])
        if below and (frame.order or ORDER in frame.df.columns):
            ranks = [] if tree else [F.col(f"r{k}{nested.RANK}") for k in range(len(below))]
            frame = replace(frame, df=frame.df.orderBy(*frame.order, *([F.col(ORDER)] if ORDER in frame.df.columns else []), *ranks))
        columns, out, k = [], [], 0
        for f in fields:
            if f.nested is None:
                e = f.expr if f.expr is not None else Name(f.pos, f.name)
                v = self._value(frame, e)
                columns.append(v[0].alias(f.name))
                out.append((f.name, v[1]))
                continue
            child, names = children[id(f)]
            if tree:
                columns.append(F.col("__children").alias(f.name))
                out.append((f.name, names))
            else:
                for n, (c, t) in child.columns.items():
                    taken = [x for x, _ in out]
                    columns.append(F.col(f"r{k}{c}").alias(f"{f.name}.{n}" if n in taken else n))
                    out.append((n, t))
            k += 1
        return Result(frame.df.select(*columns), out, tree)

    def _value(self, frame: Frame, e) -> tuple:
        flagged, scope = rows.with_members(frame, e, self.context)
        if flagged is not frame:
            raise QueryError("membership in a variable can't be selected", "VariableTypeMismatch", "execution", "query", *e.pos)
        v = compile_expression(e, scope)
        return checked(v), v.type

    def _global(self, fields: list[Field]) -> bool:
        return bool(aggregate_calls([], Selection(fields)))

    def _global_aggregate(self, frame: Frame, fields: list[Field]) -> Result:
        """Aggregates without a group: one row over all rows."""
        scope, parts, known = frame.scope(self.context), [], {}
        for k, (text, call) in enumerate(aggregate_calls([], Selection(fields)).items()):
            column, kind = aggregate(call, scope)
            known[text] = (f"__agg{k}", kind)
            parts.append(column.alias(f"__agg{k}"))
        total = Frame(frame.df.agg(*parts), {}, known)
        values = [self._value(total, f.expr if f.expr is not None else Name(f.pos, f.name)) for f in fields]
        return Result(total.df.select(*[c.alias(f.name) for f, (c, _) in zip(fields, values, strict=True)]), [(f.name, t) for f, (_, t) in zip(fields, values, strict=True)])
