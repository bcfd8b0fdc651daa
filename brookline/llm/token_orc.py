"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt into ranges of doc_id and sorted within, so each file holds a contiguous range in ascending order.
A file's rows hold doc_id, the start of the document within the file, and its ids as an integer list column, which the
ORC writer stores by its integer run-length encoding. Stripes are read in parallel; the min/max statistics of files,
stripes and row groups and the Bloom filters on doc_id prune what a lookup reads. Where a file starts in the whole
sequence of ids follows from the file totals, one row a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, pieces
from .pretokens import default_path, library_encoder

#: Bytes of texts that are encoded at once, or one longer text.
SLICE = 4_000_000
FILE_SCHEMA = "doc_id long, local_start long, n_tokens int, ids array<int>"
#: ORC writer settings: index rows, Bloom filter column and false-positive rate, stripe bytes. A task writes one file
#: whatever the session says, since starts count within files.
ORC_OPTIONS = {"maxRecordsPerFile": "0", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def token_rows(path: str, end_id: int | None):
    """mapInArrow: rows of FILE_SCHEMA of one range of documents, in the order in which they come."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = library_encoder(path), 0
        end = b"" if end_id is None else np.uint16(end_id).tobytes()
        for batch in rows:
            texts = batch.column("text")
            for a, b in pieces(np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64))), SLICE):
                ids, lengths = encoder.flat(texts.slice(a, b - a), end)
                ends = start + np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int32)), lists], ["doc_id", "local_start", "n_tokens", "ids"])
                start = int(ends[-1])

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 1, files: int | None = None) -> str:
    """Encodes whole texts (null: empty) and writes them to ORC files below ``path``, ascending by doc_id.

    Rows of one doc_id stay together, ordered by text, those with a null doc_id first. ``files`` ranges of doc_id, the
    session's shuffle partitions by default. An empty table writes files without rows. Other columns are ignored.
    """
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = documents(docs).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ranged.mapInArrow(token_rows(tokenizer or default_path(), end_id), FILE_SCHEMA)
    rows.write.options(**ORC_OPTIONS).orc(path)
    return path


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before, in ascending doc_id order."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.join(file_starts(spark, path), "file").select("doc_id", (F.col("local_start") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_start) with a row for each file that has rows; reads no ids."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path).select(F.col("_metadata.file_path").alias("file"), "doc_id", "n_tokens")
    totals = rows.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("file_start"))


def find_tokens(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """A document's rows; the predicate reaches the ORC reader, which prunes by statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "n_tokens", "ids")


def _checksums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("local_start"), batch.column("n_tokens").cast(pa.int64()), pa.array(sums, pa.int64()), batch.column("file")], ["doc_id", "local_start", "n_tokens", "ids_crc32", "file"])


def op4_token_orc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-orc")
    path = write_token_orc(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch.path}/ids")
    rows = spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_path"))
    sums = rows.mapInArrow(_checksums, "doc_id long, local_start long, n_tokens long, ids_crc32 long, file string")
    return sums.join(file_starts(spark, path), "file").select("doc_id", (F.col("local_start") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
