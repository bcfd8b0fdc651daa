"""Stateless pipelines over a stream: each micro-batch is a version of the model's table.

An extension: the language itself has no streams. where, computed fields and a selection work row by row, so a
micro-batch gives what a batch read of its rows would. Operators that need all rows (sort, group, limit, ...) are
refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import QueryError
from ..plans.compiler import Compiler
from ..plans.nodes import Pipeline
from ..plans.parser import parse_request
from ..sources.catalog import Catalog, model_of

ROW_BY_ROW = {"where", "having", "inspect"}


def stream(source: DataFrame, name: str, text: str) -> DataFrame:
    """A streaming frame through a pipeline on model ``name``, as a streaming frame."""
    statements = parse_request(text)
    if len(statements) != 1 or not isinstance(statements[0], Pipeline) or statements[0].model != name:
        raise QueryError(f"a stream takes one pipeline on {name}")
    p = statements[0]
    if any(op.kind not in ROW_BY_ROW for op in p.ops) or any(f.nested for f in (p.selection.fields if p.selection else [])):
        raise QueryError("a stream takes row-by-row operators only")
    catalog = Catalog()
    catalog.add(model_of(name, source))
    return Compiler(catalog, lambda _: source).read(p).df


def start(source: DataFrame, name: str, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a pipeline over what the stream has, appending its rows to Parquet files."""
    return stream(source, name, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
