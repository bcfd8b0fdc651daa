"""Packing documents into training sequences by best-fit decreasing.

A document longer than a window is cut into full windows and a rest. The rests (and full windows) are dealt into groups
of about GROUP pieces by a hash; each group is packed on its own, longest piece first, each into the tightest open
window that holds it. Open windows are indexed by remaining capacity in a segment tree, so finding the tightest one
takes log2(window) steps. Only lengths and checksums are shuffled, never ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents
from .pretokens import default_path, library_encoder, slices

WINDOW, GROUP = 2048, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, item: int) -> None:
        self.open[capacity].append(item)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and gives (capacity, item) of the smallest capacity that is at least ``least``."""
        node, count = least + self.size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.size
        item = self.open[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, item


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window of each piece, offset there, number of windows); lengths come in descending order, none over window."""
    tree, where, offset, used = CapacityTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length) if length < window else None
        if found is None:
            capacity, item = window, used
            used += 1
        else:
            capacity, item = found
        where.append(item)
        offset.append(window - capacity)
        if capacity > length:
            tree.add(capacity - length, item)
    return where, offset, used


def cut_pieces(path: str, end_id: int, window: int):
    """mapInArrow: the pieces (PIECES) of whole texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(path), np.uint16(end_id).tobytes()
        for batch in rows:
            texts, docs = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                out = []
                for doc, own in zip(docs[a:b], encoder.ids(texts[a:b]), strict=True):
                    ids = np.frombuffer(own + end, np.uint16).astype("<u4")
                    out += [(doc, at, min(window, len(ids) - at), zlib.crc32(ids[at : at + window]), len(ids)) for at in range(0, len(ids), window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _packer(window: int, groups: int):
    """Grouped map: the pieces of a group with their sequences. Ties in length: by doc_id (null ones last), start, checksum, row."""

    def pack(table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")]
        table = table.sort_by(keys)
        where, offset, _ = best_fit_decreasing(table.column("length").to_pylist(), window)
        sequence = np.array(where, np.int64) * groups + table.column("part")[0].as_py()
        return table.drop_columns(["part", "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack_documents(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of the whole texts.

    Each text (null: empty) is its ids and ``end_id``, so an empty one is a piece of one id. Pieces of a sequence are
    gapless from offset 0 and at most ``window`` ids long together. Rows of one doc_id, and rows without one, are
    documents of their own. Pieces are dealt by the place of their row, so equal rows go to different groups. Pieces of
    one length are taken in the order of doc_id. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = documents(docs).mapInArrow(cut_pieces(path or default_path(), end_id, window), PIECES)
    pieces = scratch.table(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part")
    return pieces.select("*", part).groupBy("part").applyInArrow(_packer(window, groups), f"{PIECES}, sequence_id long, offset long")


def op9_pack_documents(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
