"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are cut into at most BINS quantile bins; trees grow level by level from histograms of gradients and Hessians of
the logistic loss, and are flattened into arrays (feature, threshold, children, value) that numpy walks for whole
batches at once. Training reads at most SAMPLE labelled rows, the least by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .text_stats import FEATURES, features, slices_of

SAMPLE, BINS, TREES, DEPTH, RATE, LEAST_HESSIAN, RIDGE = 20_000, 64, 80, 4, 0.15, 1.0, 1.0


class Forest:
    """Flattened trees. A leaf's children are itself, so every walk takes ``depth`` steps."""

    def __init__(self, start: float, depth: int):
        self.start, self.depth = start, depth
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def node(self) -> int:
        k = len(self.feature)
        for column, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, 0.0)):
            column.append(x)
        return k

    def arrays(self) -> tuple:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right), np.array(self.value), list(self.roots), self.start, self.depth


def margin(forest: tuple, x: np.ndarray) -> np.ndarray:
    """Log odds of label 1 for the rows of x."""
    feature, threshold, left, right, value, roots, start, depth = forest
    out, rows = np.full(len(x), start), np.arange(len(x))
    for root in roots:
        at = np.full(len(x), root)
        for _ in range(depth):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        out += value[at]
    return out


def probability(forest: tuple, x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin(forest, x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> tuple:
    """A forest for labels y of 0 and 1. Without rows, or with one label only, it is a constant."""
    base = (y.sum() + 1.0) / (len(y) + 2.0)
    forest = Forest(float(np.log(base / (1 - base))), depth)
    if len(np.unique(y)) < 2:
        return forest.arrays()
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)])
    flat = binned + np.arange(width) * bins
    score = np.full(n, forest.start)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
        forest.roots.append(root := forest.node())
        where = np.full(n, root)
        level = [(root, np.arange(n))]
        for step in range(depth + 1):
            following = []
            for node, rows in level:
                g, h = gradient[rows].sum(), hessian[rows].sum()
                forest.value[node] = -rate * g / (h + RIDGE)
                if step == depth or h < 2 * LEAST_HESSIAN:
                    continue
                own = flat[rows].ravel()
                gs = np.bincount(own, np.repeat(gradient[rows], width), bins * width).reshape(width, bins).cumsum(1)[:, :-1]
                hs = np.bincount(own, np.repeat(hessian[rows], width), bins * width).reshape(width, bins).cumsum(1)[:, :-1]
                gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
                gain[(hs < LEAST_HESSIAN) | (h - hs < LEAST_HESSIAN)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                low = binned[rows, f] <= b
                forest.feature[node], forest.threshold[node] = int(f), float(cuts[f][b])
                forest.left[node], forest.right[node] = forest.node(), forest.node()
                for child, part in ((forest.left[node], rows[low]), (forest.right[node], rows[~low])):
                    where[part] = child
                    following.append((child, part))
            level = following
        score += np.array(forest.value)[where]
    return forest.arrays()


FEATURE_SCHEMA = "doc_id long, features array<double>"


def feature_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for start, end, s in slices_of(batch.column("text")):
            x = features(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start).cast(pa.int64()), lists], ["doc_id", "features"])


def scores(forest: tuple):
    """mapInArrow: the batch's columns with score, for a frame that has text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [probability(forest, features(s)) for _, _, s in slices_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*batch.schema.names, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """A forest from documents and labels (doc_id, quality); rows without a quality of 0 or 1 teach nothing.

    At most ``sample`` labelled documents are read, the least by a hash of their id, so the driver's share is bounded.
    A document that stands k times and has m labels gives k * m rows; beyond ``sample`` the first by that order count.
    """
    order = F.xxhash64("doc_id")
    chosen = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").orderBy(order, "doc_id", "quality").limit(sample)
    # Broadcasts are of at most ``sample`` rows of two numbers.
    texts = documents(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    known = texts.select("doc_id", "text").mapInArrow(feature_rows, FEATURE_SCHEMA).join(F.broadcast(chosen), "doc_id")
    rows = known.select("features", "quality").orderBy(order, "quality", "features").limit(sample).collect()
    x = np.array([r.features for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.quality for r in rows], np.float64))


def quality_scores(docs: DataFrame, forest: tuple) -> DataFrame:
    """(doc_id, score) of every whole text, one row for each row; a null text is an empty one and gets a score too.

    Other columns are ignored; an empty table gives an empty result.
    """
    return documents(docs).mapInArrow(scores(forest), "doc_id long, text string, score double").select("doc_id", "score")


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    forest = train(docs, labels.where(~held_out))
    out = quality_scores(docs, forest)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
