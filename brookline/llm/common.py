"""Shared pieces: scratch tables in the cluster's shared folder, vectorised word hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files of a finished SQL execution go at once instead of waiting for the driver's
#: garbage collector, and what goes to a Python worker at once is bounded in bytes, whatever a row holds.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextlib.contextmanager
def writing(spark: SparkSession, **more: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in (WRITING | more).items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Intermediate tables of one operator run, below ``spark.checkpoint.dir``.

    A written table cuts lineage and survives lost executors, since the folder is shared by the whole cluster.
    The setting is read from the session; only where it is unset and the master is local (tests) a temporary folder is used.
    ``batch`` bounds, in bytes, what goes to a Python worker at once, ``group`` a row group, which a task that writes or
    reads large rows holds whole.
    """

    def __init__(self, spark: SparkSession, name: str, batch: int | None = None, group: int | None = None):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            base = "file://" + tempfile.mkdtemp(prefix="scratch-")
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.batch = {"spark.sql.execution.arrow.maxBytesPerBatch": str(batch)} if batch else {}
        # The writer looks at its size after so many rows.
        self.options = {"parquet.block.size": group, "parquet.page.size.row.check.min": 1} if group else {}

    def write(self, df: DataFrame, name: str, by: str | None = None) -> str:
        """Writes a table; ``by`` names a column whose values get a folder each."""
        path = f"{self.path}/{name}"
        with writing(self.spark, **self.batch):
            df.write.options(compression="zstd", **self.options).parquet(path, partitionBy=by)
        return path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name))

    def empty(self, df: DataFrame) -> bool:
        """Whether a frame has no row."""
        with writing(self.spark, **self.batch):
            return df.isEmpty()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null text: empty) of a table whatever other columns it has."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


# ---------------------------------------------------------------------------------------------------------------
# Words and their hashes
# ---------------------------------------------------------------------------------------------------------------

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte value, and odd multipliers for the words of a shingle.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POSITION = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RADIX = 0x9E3779B97F4A7C15 | 1
RADIX_INVERSE = pow(RADIX, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves each output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            return string_bytes(column.fill_null(""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in ``data`` of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and the n + 1 word offsets of rows."""
    inside = ~SPACE[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a row's first and last byte end words too
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], lower-cased (A-Z) unless told otherwise."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lowered = np.frombuffer(data.tobytes().translate(LOWER), np.uint8) if lower else data
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[lowered] * _power(RADIX, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(RADIX_INVERSE, len(data))[starts])


def _long_text(data: np.ndarray, most: int) -> np.ndarray:
    """The word hashes of one long text, hashed in parts of about ``most`` bytes that end at white space."""
    found, start = [], 0
    while start < len(data):
        end = min(start + most, len(data))
        while end < len(data) and not SPACE[data[end]]:
            spaces = np.flatnonzero(SPACE[data[end : end + most]])
            end = end + int(spaces[0]) if len(spaces) else min(end + most, len(data))
        part = data[start:end]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        found.append(word_hashes(part, starts, ends))
        start = end
    return np.concatenate(found)


def hashed_words(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, word offsets of the rows) of small slices of a string column.

    Work memory is about 40 bytes a byte of a slice, and a longer text takes 8 bytes a word beside that of one slice.
    """
    data, offsets = string_bytes(column)
    for start, end in pieces(offsets, most):
        own = offsets[start : end + 1] - offsets[start]
        part = data[offsets[start] : offsets[end]]
        if len(part) > most:
            words = _long_text(part, most)
            yield start, end, words, np.array([0, len(words)])
            continue
        starts, ends, words = word_spans(part, own)
        yield start, end, word_hashes(part, starts, ends), words


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles of n words, sorted; a shorter row is one shingle, a row without words has none."""
    if len(words) >= n:
        width = len(words) - n + 1
        rolled = np.zeros(width, np.uint64)
        for j in range(n):
            rolled += words[j : j + width] * POSITION[j]
        rolled = mix(rolled)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            own = np.sort(rolled[a : b - n + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = np.append(words[a:b], np.uint64(b - a)) * POSITION[: b - a + 1]
            yield mix(own.sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)


def set_hash(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set of token hashes."""
    total = int(mix(tokens ^ POSITION[60]).sum(dtype=np.uint64)) + len(tokens) * RADIX
    return int(mix(np.array([total % 2**64], np.uint64)).view(np.int64)[0])


def release() -> None:
    """Gives freed memory back to the system, which a worker's allocators would keep from task to task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def batches(function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]):
    """``mapInArrow`` function from one that takes a batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield from function(batch)

    return run


# ---------------------------------------------------------------------------------------------------------------
# Connected components
# ---------------------------------------------------------------------------------------------------------------


def components(scratch: Scratch, links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that links reach.

    Alternating large-star and small-star rounds on DataFrames: each round is two aggregations and two joins on
    node ids, and the number of rounds grows with the logarithm of the longest chain. Each round's links are a
    table in the shared folder, so lineage stays short. No links: an empty frame.
    """
    edges, done = links.where("a <> b").select("a", "b"), False
    for k in range(1, rounds + 1):
        # Large star: every larger neighbour of u links to the least of u and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: every smaller neighbour of u, and u, link to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        edges = scratch.table(small.where("a <> b").distinct(), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        # Done once each node has one link, to a node that has none.
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(edges.select("b", F.lit(0), F.lit(1)))
        if scratch.empty(ends.groupBy("u").agg(F.sum("x").alias("x"), F.max("y").alias("y")).where("x > 1 or x = 1 and y = 1")):
            done = True
            break
    if not done:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
