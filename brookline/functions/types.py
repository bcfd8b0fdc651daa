"""The twelve scalar types, their Spark types, and the rules by which they mix."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNED = {"i8": (-(2**7), 2**7 - 1), "i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1)}
UNSIGNED = {"u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1)}
INTEGERS = SIGNED | UNSIGNED
NUMERIC = {*INTEGERS, "f64"}
#: Unsigned types are kept in the next wider Spark type; u64 in a decimal.
SPARK = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f64": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "timestamp": T.TimestampType(),
}
NAMES = set(SPARK)


def inferred(kind: T.DataType) -> str | None:
    """The type of a column of a file; None for what the type set lacks."""
    simple = {T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.DoubleType: "f64", T.FloatType: "f64", T.BooleanType: "bool", T.StringType: "string", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}
    if isinstance(kind, T.DecimalType):
        return "u64" if kind.scale == 0 and kind.precision == 20 else None
    return simple.get(type(kind))


def arithmetic(a: str, b: str) -> str | None:
    """The type of a + b; None where it isn't defined."""
    if a not in NUMERIC or b not in NUMERIC:
        return None
    if a == b:
        return a
    if "f64" in (a, b):
        return "f64"
    return "i64" if a in SIGNED or b in SIGNED else "u64"


def comparable(a: str, b: str) -> bool:
    return a == b or "null" in (a, b) or a in NUMERIC and b in NUMERIC


def literal_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "i64" if value < 2**63 else "u64"
    return "f64" if isinstance(value, float) else "string"
