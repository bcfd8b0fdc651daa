"""Sessions: requests of several statements, variables, transactions and responses."""

from __future__ import annotations

import re
import time
from collections import deque
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .operators import advisor
from .operators.inspection import inspected, runtime
from .operators.mutations import Mutator
from .plans.compiler import Compiler, Result
from .plans.frames import Context, Frame, Variable
from .plans.nodes import Expr, Let, ListOf, Literal, Name, ObjectOf, Pipeline
from .plans.parser import parse_request
from .plans.response import payload_text, response_text
from .sources.catalog import Catalog, Model, empty, model_of, parquet
from .sources.tables import Tables

CHANGES = {"insert", "update", "delete"}
#: Metric records that a session keeps, the latest.
KEPT_RECORDS = 10_000


@dataclass
class Outcome:
    """What a request gives: its final statement's rows or payload, and the sums of its changes."""

    result: Result | None = None
    payload: object = None
    has_payload: bool = False
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    inspect: str = ""


class Session:
    """A database of models. ``run`` answers in text, ``query`` gives the final statement's rows as a DataFrame."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog, self.tables = spark, Catalog(), Tables()
        self.open, self.records = False, deque(maxlen=KEPT_RECORDS)
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    # Models

    def define(self, source: str) -> None:
        for model in self.catalog.define(source):
            self.tables.put(model.name, empty(self.spark, model))

    def register(self, name: str, df: DataFrame, primary: str | None = None) -> Model:
        """A model with the columns of a frame, over its rows."""
        model = self.catalog.add(model_of(name, df, primary))
        self.tables.put(name, df)
        return model

    def register_parquet(self, name: str, path: str, primary: str | None = None) -> Model:
        return self.register(name, parquet(self.spark, path), primary)

    def load(self, name: str, df: DataFrame) -> None:
        """Rows for a defined model, without checks."""
        self.tables.put(name, df.select(*self.catalog.model(name).columns))

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def vacuum(self) -> int:
        """Deletes the versions that mutations and variables wrote and no table reads any more; how many.

        A frame that ``query`` gave before it can't be run again if it reads one of them.
        """
        return self.tables.vacuum(self.spark)

    # Requests

    def run(self, text: str, params: dict[str, object] | None = None) -> str:
        """The response to a request; errors are lines of text too."""
        word = text.strip().upper()
        if re.fullmatch(r"inspect\s+runtime(\s+--format\s+json)?", text.strip()):
            return runtime(self.spark) + "\n"
        try:
            if word in ("BEGIN", "COMMIT", "ROLLBACK"):
                return self.control(word)
            out = self.execute(text, params)
            return response_text(out)
        except QueryError as e:
            return e.text() + "\n"

    def control(self, word: str) -> str:
        if word == "BEGIN":
            if self.open:
                raise QueryError("transaction already open", "TransactionState")
            self.tables.begin()
            self.open = True
        else:
            if not self.open:
                raise QueryError("no open transaction", "TransactionState")
            self.tables.commit() if word == "COMMIT" else self.tables.rollback()
            self.open = False
        return f"OK {word}\n"

    def query(self, text: str, params: dict[str, object] | None = None, flat: bool = True) -> DataFrame:
        """The rows of the final statement, lazily; its changes are made at once."""
        out = self.execute(text, params, flat, lazy=True)
        if out.result is None:
            return self.spark.createDataFrame([(payload_text(out.payload),)], "payload string")
        return out.result.df

    def execute(self, text: str, params: dict[str, object] | None = None, flat: bool = False, lazy: bool = False) -> Outcome:
        """Runs all statements as one unit: an error undoes the request's changes."""
        began, failed, out, statements = time.time_ns(), True, Outcome(), []
        try:
            statements = parse_request(text)
            self._execute(statements, Context({}, params or {}, began // 1000), out, flat, lazy)
            failed = False
        finally:
            self._record(began, statements, out, failed)
        return out

    def _record(self, began: int, statements: list, out: Outcome, failed: bool) -> None:
        """A metric record of a request. Rows scanned and matched are Spark's to know and stay 0 here."""
        kinds = {op.kind for s in statements if isinstance(s, Pipeline) for op in s.ops}
        changes = kinds & CHANGES
        operation = "mixed" if len(changes) > 1 else changes.pop() if changes else "select"
        self.records.append((began // 1000, operation, "where" in kinds, failed, False, 0, 0, 0, 0, 0, 0, 0, time.time_ns() - began))

    def metrics(self) -> DataFrame:
        """The kept records, a row a request, as the advisor takes them."""
        return self.spark.createDataFrame(list(self.records), advisor.SCHEMA)

    def advise(self, records: DataFrame | None = None) -> dict[str, dict]:
        """Each rule's row, over the session's records or given ones."""
        records = self.metrics() if records is None else records
        return {name: rule(records).first().asDict() for name, rule in advisor.RULES.items()}

    def _execute(self, statements: list, context: Context, out: Outcome, flat: bool, lazy: bool) -> None:
        savepoint = dict(self.tables.staged) if self.open else None
        if not self.open:
            self.tables.begin()
        index = 0
        try:
            for index, s in enumerate(statements):
                self._statement(s, context, out, last=index == len(statements) - 1, flat=flat)
            if out.result is not None and not lazy:
                out.result.df = _collected(out.result)
        except QueryError as e:
            self._undo(savepoint)
            if len(statements) > 1 and e.statement is None:
                e.statement = index
            raise
        except (PySparkException, Py4JError) as e:
            self._undo(savepoint)
            raise runtime_error(e, index if len(statements) > 1 else None, statements[index]) from None
        except BaseException:
            self._undo(savepoint)
            raise
        if not self.open:
            self.tables.commit()

    def _undo(self, savepoint: dict[str, DataFrame] | None) -> None:
        if savepoint is None:
            self.tables.rollback()
        else:  # an explicit transaction goes on without this request
            self.tables.staged = savepoint

    def _statement(self, s, context: Context, out: Outcome, last: bool, flat: bool) -> None:
        compiler = Compiler(self.catalog, lambda name: self.tables[name], context)
        if isinstance(s, Let):
            if s.name in context.variables:
                raise QueryError(f"variable {s.name} is already defined", "DuplicateVariable", "execution", "query", *s.pos)
            context.variables[s.name] = self._variable(s.value, compiler, context)
            return
        if isinstance(s, Pipeline):
            if s.selection is None:
                raise QueryError("pipeline needs a selection block", "MissingReturningBlock", "parse", "query", *s.pos)
            if any(op.kind in CHANGES for op in s.ops):
                change = Mutator(compiler, self.tables).run(s)
                out.inserted, out.updated, out.deleted = out.inserted + change.inserted, out.updated + change.updated, out.deleted + change.deleted
                model = self.catalog.model(s.model)
                if last:
                    frame = Frame(change.rows, {c.name: (c.name, c.type) for c in model.columns.values()})
                    out.result = compiler.project(frame, model, s.selection, flat) if s.selection.fields else Result(change.rows.select().limit(0), [])
                return
            if last:
                out.result = compiler.read(s, flat)
                if out.result.inspect:
                    out.inspect = inspected(out.result.df)
            else:
                compiler.read(s, flat)  # its types are checked; its rows aren't part of the response
            return
        if last:
            out.payload, out.has_payload = self._payload(s, compiler, context), True

    def _variable(self, value, compiler: Compiler, context: Context):
        if isinstance(value, Pipeline):
            result = compiler.read(value)
            if len(result.fields) != 1:
                raise QueryError("a variable takes one column", "VariableShape", "execution", "query", *value.pos)
            kind = result.fields[0][1]
            frame = self.tables.materialized(result.df)
            head = frame.take(2)
            nulls = not frame.where(F.col(frame.columns[0]).isNull()).isEmpty()
            return Variable(frame, kind, head[0][0] if len(head) == 1 else None, len(head) == 1, nulls)
        return self._payload(value, compiler, context)

    def _payload(self, e: Expr, compiler: Compiler, context: Context):
        """An expression without a source, evaluated; lists and objects on the driver, their values by Spark."""
        if isinstance(e, ListOf):
            return [self._payload(x, compiler, context) for x in e.items]
        if isinstance(e, ObjectOf):
            return {k: self._payload(x, compiler, context) for k, x in e.items}
        if isinstance(e, Literal):
            return e.value
        if isinstance(e, Name) and e.name in context.variables:
            v = context.variables[e.name]
            if not isinstance(v, Variable):
                return v
            return v.scalar if v.is_scalar else [r[0] for r in v.frame.collect()]
        one = Frame(self.spark.range(1), {})
        column, kind = compiler._value(one, e)
        value = one.df.select(F.unix_micros(column) if kind == "timestamp" else column).first()[0]
        return int(value) if kind == "u64" and value is not None else value


def _collected(result: Result) -> list:
    """The rows of a response, with timestamps as microseconds."""
    df = result.df
    times = {c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")) for c, (_, t) in zip(df.columns, result.fields, strict=False) if t == "timestamp"}
    return (df.withColumns(times) if times else df).collect()


def runtime_error(e: PySparkException | Py4JError, index: int | None, statement) -> QueryError:
    found = re.search(r"QERR:(\w+):", str(e))
    if found:
        return QueryError("select computed expression evaluation failed", found[1], "execution", "query", *statement.pos, index)
    if any(f"[{x}" in str(e) for x in ("ARITHMETIC_OVERFLOW", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE")):
        return QueryError("aggregate evaluation failed", "IntegerOverflow", "execution", "query", *statement.pos, index)
    return QueryError(str(e).splitlines()[0][:300], "QueryExecutionError", "execution", "query", *statement.pos, index)
