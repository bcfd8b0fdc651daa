"""Scalar functions: each takes (position, [(column, type), ...]) and gives (column, type, error column or None)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .types import NUMERIC, SPARK, UNSIGNED, comparable

Args = list[tuple[Column, str]]
Result = tuple[Column, str, Column | None]


def _wrong(pos: tuple[int, int], name: str) -> QueryError:
    return QueryError(f"arguments of {name}() don't fit", "TypeMismatch", "execution", "query", *pos)


def _number(pos: tuple[int, int], args: Args, name: str) -> tuple[Column, str]:
    if len(args) != 1 or args[0][1] not in {*NUMERIC, "null"}:
        raise _wrong(pos, name)
    return args[0]


def _text(pos: tuple[int, int], args: Args, name: str) -> Column:
    if len(args) != 1 or args[0][1] not in ("string", "null"):
        raise _wrong(pos, name)
    return args[0][0].cast("string")


def absolute(pos: tuple[int, int], args: Args) -> Result:
    x, kind = _number(pos, args, "abs")
    if kind in {*UNSIGNED, "null"}:
        return x, kind, None
    if kind == "f64":
        return F.abs(x), kind, None
    least = F.lit({"i8": -(2**7), "i16": -(2**15), "i32": -(2**31), "i64": -(2**63)}[kind]).cast(SPARK[kind])
    return F.when(x != least, F.abs(F.when(x != least, x))), kind, F.when(x == least, "IntegerOverflow")


def square_root(pos: tuple[int, int], args: Args) -> Result:
    x, _ = _number(pos, args, "sqrt")
    x = x.cast("double")
    return F.when(x >= 0, F.sqrt(x)), "f64", F.when(x < 0, "NumericDomain")


def round_half_even(pos: tuple[int, int], args: Args) -> Result:
    x, _ = _number(pos, args, "round")
    return F.rint(x.cast("double")), "f64", None


def length(pos: tuple[int, int], args: Args) -> Result:
    """Bytes, not characters."""
    return F.octet_length(_text(pos, args, "length")).cast("bigint"), "i64", None


def lower(pos: tuple[int, int], args: Args) -> Result:
    """A-Z only."""
    return F.translate(_text(pos, args, "lower"), string.ascii_uppercase, string.ascii_lowercase), "string", None


def upper(pos: tuple[int, int], args: Args) -> Result:
    """a-z only."""
    return F.translate(_text(pos, args, "upper"), string.ascii_lowercase, string.ascii_uppercase), "string", None


def trim(pos: tuple[int, int], args: Args) -> Result:
    """U+0020 only."""
    return F.trim(_text(pos, args, "trim")), "string", None


def coalesce(pos: tuple[int, int], args: Args) -> Result:
    kinds = {k for _, k in args if k != "null"}
    if not args or any(not comparable(a, b) for a in kinds for b in kinds):
        raise _wrong(pos, "coalesce")
    if not kinds:
        return F.lit(None), "null", None
    kind = kinds.pop() if len(kinds) == 1 else "f64" if "f64" in kinds else "u64" if kinds <= {*UNSIGNED} else "i64"
    return F.coalesce(*[c.cast(SPARK[kind]) for c, _ in args]), kind, None


FUNCTIONS = {"abs": absolute, "sqrt": square_root, "round": round_half_even, "length": length, "lower": lower, "upper": upper, "trim": trim, "coalesce": coalesce}
