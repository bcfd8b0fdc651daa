"""Syntax trees of requests and schemas. Positions are (line, column), both from 1."""

from __future__ import annotations

from dataclasses import dataclass, field

Pos = tuple[int, int]


@dataclass
class Expr:
    pos: Pos


@dataclass
class Literal(Expr):
    value: object  # int, float, str, bool or None


@dataclass
class Name(Expr):
    name: str


@dataclass
class Param(Expr):
    name: str  # with the $


@dataclass
class Now(Expr):
    pass


@dataclass
class Unary(Expr):
    op: str
    operand: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    star: bool = False


@dataclass
class ListOf(Expr):
    items: list[Expr]


@dataclass
class ObjectOf(Expr):
    items: list[tuple[str, Expr]]


@dataclass
class SortKey:
    expr: Expr
    descending: bool = False


@dataclass
class Op:
    kind: str  # where having sort limit offset group unique scope inspect insert update delete
    pos: Pos
    expr: Expr | None = None
    keys: list[SortKey] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    rows: list[list[tuple[str, Expr, Pos]]] = field(default_factory=list)


@dataclass
class Field:
    pos: Pos
    name: str
    expr: Expr | None = None
    nested: Selection | None = None
    ops: list[Op] = field(default_factory=list)


@dataclass
class Selection:
    fields: list[Field]


@dataclass
class Pipeline:
    pos: Pos
    model: str
    ops: list[Op]
    selection: Selection | None


@dataclass
class Let:
    pos: Pos
    name: str
    value: Pipeline | Expr


Statement = Pipeline | Let | Expr


def walk(e: Expr | None):
    """The expression and all below it."""
    if e is None:
        return
    yield e
    for x in (getattr(e, "operand", None), getattr(e, "left", None), getattr(e, "right", None), *getattr(e, "args", ())):
        yield from walk(x)
    for x in getattr(e, "items", ()):
        yield from walk(x[1] if isinstance(x, tuple) else x)
