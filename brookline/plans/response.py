"""Responses as text: a status line, then rows, a shape and a tree, or one payload."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

#: Type names in the shape line of a tree.
SHAPE = {"string": "str"}


def number(value: float) -> str:
    """A float in decimal digits, without an exponent and without a trailing .0."""
    if value != value or value in (float("inf"), float("-inf")):
        return str(value)
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def scalar_text(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return number(value)
    if isinstance(value, datetime.datetime):
        value = value.replace(tzinfo=value.tzinfo or datetime.UTC)
        return str((value - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1))
    return str(value)


def quoted(value: object) -> str:
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return scalar_text(value)


def payload_text(value: object) -> str:
    """Lists and objects as JSON; a string alone as it is."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{inner_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(inner_text, value)) + "]"
    return scalar_text(value)


def inner_text(value: object) -> str:
    return payload_text(value) if isinstance(value, (dict, list)) else quoted(value)


def shape_text(fields: list[tuple[str, object]]) -> str:
    parts = [f"{n}:[{shape_text(t)}]" if isinstance(t, list) else f"{n}:{SHAPE.get(t, t)}" for n, t in fields]
    return "{" + ",".join(parts) + "}"


def response_text(out) -> str:
    """``out.result.df`` holds the collected rows here."""
    found = out.result.df if out.result is not None else []
    count = 1 if out.has_payload else len(found)
    if out.result is not None and not out.result.fields:
        count, found = 0, []
    lines = [f"OK returned_rows={count} inserted_rows={out.inserted} updated_rows={out.updated} deleted_rows={out.deleted}"]
    if out.has_payload:
        lines.append(payload_text(out.payload))
    elif out.result is not None and out.result.tree:
        lines.append(shape_text(out.result.fields))
        for row in found:
            cells = ["[" + ",".join("[" + ",".join(map(quoted, child)) + "]" for child in v) + "]" if isinstance(t, list) else quoted(v) for v, (_, t) in zip(row, out.result.fields, strict=True)]
            lines.append(",".join(cells))
    else:
        lines += [",".join(map(scalar_text, row)) for row in found]
    return "\n".join(lines) + "\n" + out.inspect
