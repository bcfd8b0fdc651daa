"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams of 1 to 3 letters, in order, counted over all labelled training
texts. A document's own most frequent n-grams are compared to each profile by the out-of-place distance: the sum of
how far each n-gram's rank is from its rank in the profile, with the profile's size for one that is not in it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents
from .pretokens import slices

PROFILE = 400
#: Words are runs of letters (``str.isalpha``), with one edge mark on both sides. The pattern also takes numbers that are no
#: digits, as one half; they separate words as digits do.
WORD = re.compile(r"[^\W\d_]+")
EDGE = 0x20


def words_of(text: str) -> list[str]:
    words = WORD.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in text).split()


def gram_ids(text: str) -> np.ndarray:
    """The n-grams of a text, each as up to three code points of 21 bits; edges alone are no n-gram."""
    letters = " ".join(["", *words_of(text.lower()), ""])
    if len(letters) < 3:
        return np.zeros(0, np.int64)
    points = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    inner = points[1:-1] != EDGE  # three letters around an edge span two words
    return np.concatenate((points[points != EDGE], two, three[inner]))


def ranked(ids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, most frequent first, ties by value."""
    grams, counts = np.unique(ids, return_counts=True)
    if len(grams) > 4 * most:  # only what may get into the profile is put in order
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:most]]


#: N-grams that a task counts before it passes them on.
MOST_GRAMS = 500_000


def training_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (lang, gram, n) of a task's texts; an n-gram may come several times."""
    total: dict[str, Counter] = defaultdict(Counter)

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])
        total.clear()

    for batch in rows:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for a, b in slices(texts, 1_000_000):
            by: dict[str, list[np.ndarray]] = defaultdict(list)
            for text, lang in zip(texts[a:b], langs[a:b], strict=True):
                by[lang].append(gram_ids(text))
            for lang, ids in by.items():
                grams, counts = np.unique(np.concatenate(ids), return_counts=True)
                own = total[lang]
                for g, c in zip(grams.tolist(), counts.tolist(), strict=True):
                    own[g] += c
            if sum(map(len, total.values())) > MOST_GRAMS:
                yield from counted()
    yield from counted()


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its profile, from the texts with a non-null lang. The driver gets ``size`` rows a language."""
    texts = documents(docs.where("lang is not null and text is not null"), "lang").select("text", "lang")
    counts = texts.mapInArrow(training_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():
        out.setdefault(row.lang, []).append(row.gram)
    return out


def predictions(profiles: dict[str, list[int]], size: int):
    """mapInArrow: (doc_id, lang_pred, score)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(profiles)
        grams = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.int64)
        place = np.full((len(langs), len(grams) + 1), -1, np.int64)  # the last column: in no profile
        for k, lang in enumerate(langs):
            place[k, np.searchsorted(grams, profiles[lang])] = np.arange(len(profiles[lang]))
        for batch in rows:
            best, scores = [], []
            for text in batch.column("text").to_pylist():
                own = ranked(gram_ids(text), size) if text else np.zeros(0, np.int64)
                if not len(own) or not langs:
                    best.append("und")
                    scores.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                at[grams[at] != own] = len(grams)
                there = place[:, at]
                distance = np.where(there < 0, size, np.abs(there - np.arange(len(own)))).sum(1)
                k = int(distance.argmin())
                best.append(langs[k])
                scores.append(1.0 - float(distance[k]) / (size * len(own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, one row for each row.

    score: 1 - distance / the largest possible distance. A text that is null or has no letter is ``und`` with score 0,
    and so is any text if no language was learned. Equal distances: the first language in alphabetical order. Other
    columns are ignored; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(predictions(profiles, size), "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = identify_languages(docs, learn_profiles(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
