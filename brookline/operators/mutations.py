"""insert, update and delete on copy-on-write tables, with keys and referential integrity.

Each checks its constraints on the rows it changes, then puts a new version of the table. Nothing is put before all
checks have passed, and a request's versions are staged until it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RUNTIME, QueryError
from ..functions.expressions import Value, compile_expression, first_error, literal, matches
from ..functions.types import INTEGERS, SPARK
from ..plans.compiler import Compiler
from ..plans.frames import Frame
from ..plans.nodes import Op, Pipeline
from ..sources.catalog import Model
from ..sources.tables import Tables
from . import rows

HIT = "__hit"


@dataclass
class Change:
    """inserted, updated, deleted: counts; rows: the affected rows, new ones (or the deleted ones)."""

    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    rows: DataFrame | None = None


def assigned(v: Value, column, verb: str, pos: tuple[int, int]) -> Value:
    """A value converted to a column's type: exact, integers narrowed with a range check, integers to f64 and timestamp."""
    t, path = column.type, f"{verb}.{column.name}"
    if v.type == "null":
        return Value(F.lit(None).cast(SPARK[t]), t, v.error)
    if v.type == t:
        return v
    if v.type in INTEGERS and t in INTEGERS:
        low, high = INTEGERS[t]
        wide = v.column.cast("decimal(38,0)")
        outside = ~wide.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)"))
        return Value(F.when(~outside, wide).cast(SPARK[t]), t, first_error(v.error, F.when(outside, f"IntegerOutOfRange {t}")))
    if v.type in INTEGERS and t == "f64":
        return Value(v.column.cast("double"), t, v.error)
    if v.type in INTEGERS and t == "timestamp":
        return Value(F.timestamp_micros(v.column.cast("bigint")), t, v.error)
    raise QueryError(f"value type is incompatible with {t}", "TypeMismatch", "mutation", path, *pos)


def failed(code: str, verb: str, name: str, pos: tuple[int, int]) -> QueryError:
    """The error of an assignment that failed at run time."""
    path = f"{verb}.{name}"
    if code.startswith("IntegerOutOfRange"):
        low, high = INTEGERS[code.split()[1]]
        return QueryError(f"value is out of range ({low} to {high})", "IntegerOutOfRange", "mutation", path, *pos)
    if code == "NullArithmeticOperand":
        return QueryError(RUNTIME[code], code, "mutation", path, *pos)
    return QueryError(f"{verb} failed", code)


class Mutator:
    def __init__(self, compiler: Compiler, tables: Tables):
        self.compiler, self.tables, self.catalog = compiler, tables, compiler.catalog

    def run(self, p: Pipeline) -> Change:
        model = self.catalog.model(p.model, p.pos)
        ops = self.compiler.expanded(model, p.ops)
        changes = [op for op in ops if op.kind in ("insert", "update", "delete")]
        others = [op for op in ops if op.kind not in ("insert", "update", "delete", "inspect")]
        wheres = [op for op in others if op.kind == "where"]
        if len(changes) > 1 or len(wheres) > 1 or len(wheres) < len(others) or changes[0].kind == "insert" and wheres:
            raise QueryError("a mutation takes one where and one insert, update or delete", "QueryExecutionError", "execution", "query", *changes[0].pos)
        return getattr(self, changes[0].kind)(model, changes[0], wheres[0] if wheres else None)

    # Checks

    def _fail(self, verb: str, code: str) -> QueryError:
        return QueryError(f"{verb} failed", code)

    def _not_null(self, model: Model, new: DataFrame, verb: str) -> None:
        missing = [F.col(c.name).isNull() for c in model.columns.values() if not c.nullable]
        if missing:
            found = missing[0]
            for m in missing[1:]:
                found = found | m
            if not new.where(found).isEmpty():
                raise self._fail(verb, "NullNotAllowed")

    def _unique(self, model: Model, keys: list[str], new: DataFrame, rest: DataFrame, verb: str) -> None:
        """A key with a null part is exempt."""
        new = new.select(*keys).dropna()
        twice = new.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
        if not twice.isEmpty() or not rest.select(*keys).join(new, keys, "left_semi").isEmpty():
            raise self._fail(verb, "DuplicateKey")

    def _outgoing(self, model: Model, new: DataFrame, verb: str, changed: set[str] | None = None) -> None:
        """Non-null foreign keys need a parent; one in the same batch counts."""
        for r in model.relations.values():
            if not r.integrity or changed is not None and r.local not in changed:
                continue
            parents = self.tables[r.target].select(F.col(r.target_column).alias("__p"))
            if r.target == model.name:
                parents = parents.union(new.select(F.col(r.target_column)))
            orphans = new.where(F.col(r.local).isNotNull()).join(parents, F.col(r.local) == F.col("__p"), "left_anti")
            if not orphans.isEmpty():
                raise self._fail(verb, "ReferentialIntegrityViolation")

    # Operators

    def insert(self, model: Model, op: Op, _: Op | None) -> Change:
        new = None
        spark = self.tables[model.name].sparkSession
        scope = Frame(spark.range(0), {}).scope(self.compiler.context)
        plain, computed = [], []
        for row in op.rows:
            values: dict[str, tuple[Value, tuple[int, int]]] = {}
            for name, e, pos in row:
                if name not in model.columns:
                    raise QueryError("field does not exist on model; check the schema field name or update the assignment", "ColumnNotFound", "mutation", f"insert.{name}", *pos)
                values[name] = assigned(compile_expression(e, scope), model.columns[name], "insert", e.pos), e.pos
            columns, errors = [], []
            for c in model.columns.values():
                if c.name in values:
                    v, pos = values[c.name]
                    columns.append(v.column.cast(SPARK[c.type]).alias(c.name))
                    if v.error is not None:
                        errors.append((c.name, pos, v.error))
                else:  # a default, only where nothing is assigned
                    v = assigned(literal(c.default if c.has_default else None), c, "insert", op.pos)
                    columns.append(v.column.cast(SPARK[c.type]).alias(c.name))
            (computed if errors else plain).append((columns, errors))
        for columns, errors in computed:
            found = spark.range(1).select(*[e.alias(str(k)) for k, (_, _, e) in enumerate(errors)]).first()
            for k, (name, pos, _) in enumerate(errors):
                if found[k] is not None:
                    raise failed(found[k], "insert", name, pos)
        structs = [F.struct(*columns) for columns, _ in [*plain, *computed]]
        new = spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*") if structs else None
        new = spark.createDataFrame(new.collect(), model.spark_schema())  # the request's own rows
        self._not_null(model, new, "insert")
        old = self.tables[model.name]
        for keys in [[model.primary]] * bool(model.primary) + [i.columns for i in model.indexes if i.unique]:
            self._unique(model, keys, new, old, "insert")
        self._outgoing(model, new, "insert")
        self.tables.put(model.name, self.tables.materialized(old.select(*model.columns).unionByName(new)))
        return Change(inserted=len(structs), rows=new)

    def _hits(self, model: Model, where: Op | None) -> DataFrame:
        """The table with a flag of the rows that the predicate matches."""
        frame = self.compiler.source(model)
        if where is None:
            return frame.df.withColumn(HIT, F.lit(True))
        flagged, scope = rows.with_members(frame, where.expr, self.compiler.context)
        return flagged.df.withColumn(HIT, F.coalesce(matches(compile_expression(where.expr, scope), "where", where.pos), F.lit(False))).select(*model.columns, HIT)

    def update(self, model: Model, op: Op, where: Op | None) -> Change:
        df = self._hits(model, where)
        # The old key, for children that follow it.
        parents = self.catalog.references_to(model.name)
        watched = {r.target_column for r in parents}
        df = df.withColumns({f"__old_{c}": F.col(c) for c in watched})
        problems, names = [], set()
        for k, (name, e, pos) in enumerate(op.rows[0]):
            if name not in model.columns:
                raise QueryError("field does not exist on model; check the schema field name or update the assignment", "ColumnNotFound", "mutation", f"update.{name}", *pos)
            frame, scope = rows.with_members(Frame(df, {c.name: (c.name, c.type) for c in model.columns.values()}), e, self.compiler.context)
            try:
                v = compile_expression(e, scope)
            except QueryError as x:
                if x.code == "TypeMismatch":
                    raise self._fail("update", "TypeMismatch") from None
                raise
            v = assigned(v, model.columns[name], "update", e.pos)
            kept = [c for c in df.columns]
            wanted = F.when(F.col(HIT), v.column.cast(SPARK[model.columns[name].type])).otherwise(F.col(name))
            added = {}
            if v.error is not None:
                added[f"__e{k}"] = F.when(F.col(HIT), v.error)
                problems.append((f"__e{k}", name, e.pos))
            # Later assignments see this one.
            df = frame.df.withColumns({**added, f"__n{k}": wanted}).drop(name).withColumnRenamed(f"__n{k}", name).select(*kept, *added)
            names.add(name)
        df = self.tables.materialized(df)
        for column, name, pos in problems:
            bad = df.where(F.col(column).isNotNull()).select(column).first()
            if bad:
                raise failed(bad[0], "update", name, pos)
        new, rest = df.where(HIT), df.where(~F.col(HIT))
        self._not_null(model, new, "update")
        if model.primary in names:
            self._unique(model, [model.primary], new, rest, "update")
        before = self.tables[model.name]
        self.tables.put(model.name, df.select(*model.columns))
        try:
            self._outgoing(model, new, "update", names)
            for r in parents:
                if r.target_column in names:
                    moved = new.where(~F.col(f"__old_{r.target_column}").eqNullSafe(F.col(r.target_column))).select(F.col(f"__old_{r.target_column}").alias("__k"), F.col(r.target_column).alias("__to")).where("__k is not null")
                    self._follow(r, moved, r.on_update, "update")
        except QueryError:
            self.tables.put(model.name, before)
            raise
        return Change(updated=new.count(), rows=new.select(*model.columns))

    def delete(self, model: Model, op: Op, where: Op | None) -> Change:
        df = self.tables.materialized(self._hits(model, where))
        gone, rest = df.where(HIT).drop(HIT), df.where(~F.col(HIT)).drop(HIT)
        plans = []
        for r in self.catalog.references_to(model.name):
            keys = gone.select(F.col(r.target_column).alias("__k")).where("__k is not null").distinct()
            if r.on_delete == "restrict":
                children = rest if r.model == model.name else self.tables[r.model]
                if not children.join(keys, F.col(r.local) == F.col("__k"), "left_semi").isEmpty():
                    raise self._fail("delete", "ReferentialIntegrityViolation")
            else:
                plans.append((r, keys))
        self.tables.put(model.name, rest)
        for r, keys in plans:
            self._follow(r, keys.withColumn("__to", F.lit(None)), r.on_delete, "delete")
        return Change(deleted=gone.count(), rows=gone)

    def _follow(self, r, moved: DataFrame, action: str, verb: str) -> None:
        """Children of changed (__k -> __to) or deleted parents; one level deep."""
        children = self.tables[r.model]
        on = F.col(r.local) == F.col("__k")
        if action == "restrict":
            if not children.join(moved, on, "left_semi").isEmpty():
                raise self._fail(verb, "ReferentialIntegrityViolation")
        elif action == "cascade" and verb == "delete":
            self.tables.put(r.model, self.tables.materialized(children.join(moved, on, "left_anti")))
        else:
            # One row a key: of parents that share a target value the least new value goes down.
            moved = moved.groupBy("__k").agg(F.min("__to").alias("__to")).withColumn("__m", F.lit(True))
            joined = children.join(moved, on, "left")
            value = F.col("__to").cast(children.schema[r.local].dataType) if action == "cascade" else F.lit(None).cast(children.schema[r.local].dataType)
            new = F.when(F.col("__m"), value).otherwise(F.col(r.local))
            self.tables.put(r.model, self.tables.materialized(joined.withColumn("__new", new).drop(r.local).withColumnRenamed("__new", r.local).select(*children.columns)))
