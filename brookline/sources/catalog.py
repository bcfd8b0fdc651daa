"""Models, their relations and constraints: from schema definitions, or inferred from Parquet files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.types import INTEGERS, NAMES, SPARK, inferred
from ..plans.nodes import Literal, Op, Unary
from ..plans.parser import Parser

ON_DELETE = {"onDeleteRestrict": "restrict", "onDeleteCascade": "cascade", "onDeleteSetNull": "setNull", "onDeleteSetDefault": "setDefault"}
ON_UPDATE = {"onUpdateRestrict": "restrict", "onUpdateCascade": "cascade", "onUpdateSetNull": "setNull", "onUpdateSetDefault": "setDefault"}


@dataclass
class Column:
    name: str
    type: str
    nullable: bool
    primary: bool = False
    default: object = None
    has_default: bool = False


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool


@dataclass
class Relation:
    """alias on ``model``: the rows of ``target`` whose ``target_column`` equals ``local``."""

    alias: str
    model: str
    local: str
    target: str
    target_column: str
    integrity: bool = False
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass
class Model:
    name: str
    columns: dict[str, Column] = field(default_factory=dict)
    indexes: list[Index] = field(default_factory=list)
    relations: dict[str, Relation] = field(default_factory=dict)
    scopes: dict[str, list[Op]] = field(default_factory=dict)

    @property
    def primary(self) -> str | None:
        return next((c.name for c in self.columns.values() if c.primary), None)

    def spark_schema(self) -> T.StructType:
        """The Spark schema; keys, types and defaults are kept in the fields' metadata."""
        return T.StructType([T.StructField(c.name, SPARK[c.type], True, {"type": c.type, "primaryKey": c.primary, "notNull": not c.nullable}) for c in self.columns.values()])


class Catalog:
    def __init__(self):
        self.models: dict[str, Model] = {}

    def model(self, name: str, pos: tuple[int, int] = (1, 1)) -> Model:
        if name not in self.models:
            raise QueryError(f"unknown model {name}", "ModelNotFound", "execution", "query", *pos)
        return self.models[name]

    def add(self, model: Model) -> Model:
        if model.name in self.models:
            raise QueryError(f"model {model.name} is defined twice", "DuplicateModel", "schema")
        self.models[model.name] = model
        return model

    def references_to(self, name: str) -> list[Relation]:
        """Relations with integrity whose parent is this model."""
        return [r for m in self.models.values() for r in m.relations.values() if r.integrity and r.target == name]

    def define(self, source: str) -> list[Model]:
        """Loads schema definitions: first all names, then members, then relations are resolved."""
        found = SchemaParser(source).models()
        for model, _ in found:
            self.add(model)
        for model, bare in found:
            for kind, target, pos in bare:
                self._infer(model, kind, target, pos)
        for model, _ in found:
            for r in model.relations.values():
                self._check(model, r)
        return [m for m, _ in found]

    def relate(self, model: str, alias: str, local: str, target: str, target_column: str, **more) -> None:
        r = Relation(alias, model, local, target, target_column, **more)
        self._check(self.model(model), r)
        self.models[model].relations[alias] = r

    def _infer(self, model: Model, kind: str, target_name: str, pos: tuple[int, int]) -> None:
        if kind == "belongsTo":
            raise QueryError("belongsTo needs an explicit integrity mode; use reference(...)", "InvalidSchema", "schema", "schema", *pos)
        target, own = self.model(target_name, pos), model.primary
        key = f"{model.name[0].lower()}{model.name[1:]}_id"
        key = next((k for k in (key, f"{model.name.lower()}_id") if k in target.columns), None)
        if not own or not key:
            raise QueryError(f"keys of {kind} {target_name} can't be inferred", "InvalidSchema", "schema", "schema", *pos)
        model.relations[target_name] = Relation(target_name, model.name, own, target_name, key)

    def _check(self, model: Model, r: Relation) -> None:
        target = self.model(r.target)
        if r.local not in model.columns or r.target_column not in target.columns:
            raise QueryError(f"reference {r.alias} names a column that doesn't exist", "ColumnNotFound", "schema")
        local = model.columns[r.local]
        if not r.integrity:
            return
        if "setDefault" in (r.on_delete, r.on_update):
            raise QueryError("setDefault isn't supported", "InvalidSchema", "schema")
        if local.type != target.columns[r.target_column].type:
            raise QueryError(f"columns of reference {r.alias} differ in type", "TypeMismatch", "schema")
        if "setNull" in (r.on_delete, r.on_update) and not local.nullable:
            raise QueryError(f"setNull needs a nullable column in reference {r.alias}", "InvalidSchema", "schema")


class SchemaParser(Parser):
    def models(self) -> list[tuple[Model, list]]:
        out = []
        while self.now.kind != "end":
            model, bare = Model(self.word().text), []
            self.expect("{")
            while not self.mark("}"):
                self.member(model, bare)
            out.append((model, bare))
        return out

    def member(self, model: Model, bare: list) -> None:
        t = self.word()
        if t.text == "scope":
            name = self.word().text
            model.scopes[name] = self.operators()
        elif t.text in ("hasMany", "hasOne", "belongsTo"):
            bare.append((t.text, self.word().text, t.pos))
        elif t.text == "field":
            self.expect("(")
            column = self.column()
            if column.name in model.columns:
                raise QueryError(f"field {column.name} is defined twice", "DuplicateColumn", "schema", "schema", *t.pos)
            if column.primary and model.primary:
                raise QueryError("a model has one primary key", "InvalidSchema", "schema", "schema", *t.pos)
            model.columns[column.name] = column
        elif t.text == "index":
            self.expect("(")
            name = self.word().text
            self.expect(",")
            self.expect("[")
            columns = [self.word().text]
            while self.mark(","):
                columns.append(self.word().text)
            self.expect("]")
            unique = self.mark(",") and self.expect("unique") is not None
            self.expect(")")
            if missing := [c for c in columns if c not in model.columns]:
                raise QueryError(f"index {name} names unknown field {missing[0]}", "ColumnNotFound", "schema", "schema", *t.pos)
            model.indexes.append(Index(name, columns, unique))
        elif t.text == "reference":
            self.expect("(")
            model.relations.update({(r := self.reference(model)).alias: r})
        else:
            self.at -= 1
            raise self.fail()

    def column(self) -> Column:
        t = self.word()
        self.expect(",")
        kind = self.word()
        if kind.text not in NAMES:
            raise QueryError(f"unknown type {kind.text}", "InvalidSchema", "schema", "schema", *kind.pos)
        out, nullable = Column(t.text, kind.text, True), None
        while self.mark(","):
            w = self.word().text
            if w in ("notNull", "nullable"):
                nullable = w == "nullable"
            elif w == "primaryKey":
                out.primary = True
            elif w == "default":
                self.expect(",")
                out.default, out.has_default = self.default(out), True
            else:
                raise QueryError(f"unknown option {w}", "InvalidSchema", "schema", "schema", *t.pos)
        self.expect(")")
        if nullable is None:
            raise QueryError(f"field {t.text} must be notNull or nullable", "InvalidSchema", "schema", "schema", *t.pos)
        if nullable and out.primary:
            raise QueryError("a primary key can't be nullable", "InvalidSchema", "schema", "schema", *t.pos)
        out.nullable = nullable
        return out

    def default(self, column: Column) -> object:
        e = self.unary()
        value = -e.operand.value if isinstance(e, Unary) and isinstance(e.operand, Literal) and type(e.operand.value) in (int, float) else e.value if isinstance(e, Literal) else self
        kind, t = type(value), column.type
        if kind is int and t == "f64":
            value, kind = float(value), float
        fits = (
            kind is int and (t == "timestamp" or t in INTEGERS and INTEGERS[t][0] <= value <= INTEGERS[t][1])
            or kind is float and t == "f64" or kind is bool and t == "bool" or kind is str and t == "string"
        )
        if not fits:
            raise QueryError(f"default of {column.name} doesn't fit {t}", "TypeMismatch", "schema", "schema", *e.pos)
        return value

    def reference(self, model: Model) -> Relation:
        alias = self.word().text
        self.expect(",")
        local = self.word().text
        self.expect(",")
        target = self.word().text
        self.expect(".")
        r = Relation(alias, model.name, local, target, self.word().text)
        self.expect(",")
        mode = self.word()
        if mode.text == "withReferentialIntegrity":
            r.integrity = True
            self.expect("(")
            deleted, updated = None, None
            while self.now.text != ")":
                w = self.word().text
                deleted, updated = ON_DELETE.get(w, deleted), ON_UPDATE.get(w, updated)
                if not self.mark(","):
                    break
            self.expect(")")
            if not deleted or not updated:
                raise QueryError("integrity needs an onDelete and an onUpdate action", "InvalidSchema", "schema", "schema", *mode.pos)
            r.on_delete, r.on_update = deleted, updated
        elif mode.text != "withoutReferentialIntegrity":
            raise QueryError(f"unknown integrity mode {mode.text}", "InvalidSchema", "schema", "schema", *mode.pos)
        self.expect(")")
        return r


def model_of(name: str, frame: DataFrame, primary: str | None = None) -> Model:
    """A model with the columns of a frame that the type set has; others stay hidden."""
    model = Model(name)
    for f in frame.schema.fields:
        if kind := inferred(f.dataType):
            model.columns[f.name] = Column(f.name, kind, f.name != primary, f.name == primary)
    return model


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are UTC."""
    return spark.read.parquet(path)


def empty(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([], model.spark_schema())


def statistics(frame: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct, least, greatest) of a table, in one pass; distinct counts are approximate."""
    parts = [F.count("*").alias("rows")]
    for c in frame.columns:
        parts += [F.count(c).alias(f"{c}\0n"), F.approx_count_distinct(c).alias(f"{c}\0d"), F.min(c).cast("string").alias(f"{c}\0a"), F.max(c).cast("string").alias(f"{c}\0b")]
    one = frame.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows"), (F.col("rows") - F.col(f"`{c}\0n`")).alias("nulls"), F.col(f"`{c}\0d`").alias("distinct"), F.col(f"`{c}\0a`").alias("least"), F.col(f"`{c}\0b`").alias("greatest")) for c in frame.columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
