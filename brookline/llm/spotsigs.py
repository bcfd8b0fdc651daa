"""SpotSigs fingerprints with DataFrame functions only.

A spot signature is a common word (the anchor) and the chain of the content words that follow it; a document's
fingerprint is the set of the 32-bit hashes of its signatures, as hexadecimal digits in ascending order. Sets are
compared by Jaccard similarity; sets whose sizes alone exclude a similarity are never compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "the of to and in is it that was for on be are as with by at this from not an or "
    "der die und zu den das ist von mit nicht des im dem auf als für ein eine sich "
    "le la les de du et un une que qui dans pour au par sur est pas "
    "el los las en y del se no con una su al es por lo"
).split()
#: Content words of a chain, and how many words after the anchor they may span.
CHAIN, REACH = 2, 8
#: What separates words: white space, control characters and ASCII punctuation.
BREAK = r"[\x00-/:-@\[-`{-\x7f]+"
#: No content words; an empty string stands at the ends of a text that begins or ends with a break.
NO_CONTENT = [*ANCHORS, ""]


def words(text: Column) -> Column:
    """Lower-case words without punctuation."""
    return F.split(F.lower(text), BREAK)


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes. A text without a whole chain has one: the hash of all its words."""

    def chains(all_words: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            chain = F.slice(F.filter(F.slice(all_words, i + 2, REACH), lambda x: ~x.isin(NO_CONTENT)), 1, CHAIN)
            hashed = F.transform(F.array(chain), lambda c: F.when(F.size(c) == CHAIN, F.hash(word, c)))
            return F.when(word.isin(ANCHORS), F.element_at(hashed, 1))

        found = F.array_distinct(F.filter(F.transform(all_words, one), lambda x: x.isNotNull()))
        return F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, F.array_sort(x)).otherwise(F.array(F.hash(all_words))))[0]

    # The words are bound to a variable, so they are split once a text.
    return F.transform(F.array(words(text)), chains)[0]


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def jaccard(x: Column, y: Column) -> Column:
    both = F.transform(F.array(F.size(F.array_intersect(x, y))), lambda n: n / (F.size(x) + F.size(y) - n))
    return both[0].cast("double")


def spotsigs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, signatures) of every whole text, one row for each row.

    A null text is an empty one, which has the signature of no words. Equal texts have equal fingerprints. Other
    columns are ignored; an empty table gives an empty result.
    """
    own = documents(docs).withColumn("signatures", signatures(F.col("text")))
    return own.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), fingerprint(F.col("signatures")).alias("fingerprint"), "signatures")


def similar_fingerprints(queries: DataFrame, docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """(query_id, doc_id, likeness) for the documents like each query, both as ``spotsigs`` gives them.

    Documents are partitioned by the logarithm of their set's size; a query meets only the partitions whose sizes allow
    the similarity, and there only documents that share one of its first signatures (the prefix that a similar set
    cannot miss). Queries are a stated set, so this is a search, not a self-join. A document without a partner has no row.
    """
    step = math.log(1 / similarity)

    def part(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / step).cast("int")

    size = F.size("signatures")
    prefix = F.slice("signatures", 1, size - F.ceil(size * similarity - 1e-9).cast("int") + 1)
    q = queries.select(F.col("doc_id").alias("query_id"), F.col("signatures").alias("q"), prefix.alias("prefix"), part(size).alias("p"))
    near = F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1))
    q = q.withColumn("part", near).select("query_id", "part", F.explode("prefix").alias("s"))
    d = docs.select("doc_id", part(size).alias("part"), F.explode(prefix).alias("s"))
    pairs = q.join(d, ["part", "s"]).select("query_id", "doc_id").distinct()
    sets = docs.select("doc_id", "signatures")
    both = pairs.join(sets, "doc_id").join(queries.select(F.col("doc_id").alias("query_id"), F.col("signatures").alias("q")), "query_id")
    small, large = F.least(F.size("q"), F.size("signatures")), F.greatest(F.size("q"), F.size("signatures"))
    both = both.where(small >= similarity * large).withColumn("likeness", jaccard(F.col("q"), F.col("signatures")))
    return both.where(F.col("likeness") >= similarity).select("query_id", "doc_id", "likeness")


def range_bucket(docs: DataFrame, buckets: int) -> tuple[Column, list[int]]:
    """A column that deals doc_id into at most ``buckets`` ranges of about equal counts, and their bounds."""
    shares = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", shares).alias("b")).first().b if shares else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0), []
    depth = (len(bounds) + 1).bit_length()
    table = F.lit([*bounds, *[2**63 - 1] * (2**depth - len(bounds))])
    # Binary search: the number of bounds that are at most doc_id.
    steps = F.lit([2**k for k in range(depth - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.col("doc_id") >= F.element_at(table, at + s), at + s).otherwise(at))
    return found, bounds


#: Bytes of text of a range of documents, about.
RANGE = 32_000_000


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its fingerprint, its edited text's, and their likenesses; one row for each row.

    The next document is the one after it in descending doc_id order, rows of one doc_id by their texts, those without a
    doc_id last; after the last row comes the first. A null text is an empty one. Of one row, the next is itself. An
    empty table gives an empty result. Other columns are ignored. Ranges of doc_id hold about RANGE bytes of text.
    """
    docs = documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # Each document with the next one in descending doc_id order: windows over ranges of doc_id, and the first document
    # of each range for the last one of the range before.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket, _ = range_bucket(docs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE))
    ids = docs.select("doc_id", bucket.alias("bucket"))
    heads = [(r.bucket, r.head) for r in ids.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()]  # a row a range
    heads.sort(reverse=True)
    after = {b: heads[(k + 1) % len(heads)][1] for k, (b, _) in enumerate(heads)}
    signed = docs.select("doc_id", "text", signatures(F.col("text")).alias("sigs"), bucket.alias("bucket"))
    order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    rows = signed.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    there = F.col("doc_id").isin([h for _, h in heads if h is not None])
    if any(h is None for _, h in heads):  # a range without doc_ids
        there = there | F.col("doc_id").isNull()
    first = docs.where(there).groupBy("doc_id").agg(F.min("text").alias("head_text")).withColumnRenamed("doc_id", "head")
    first = first.withColumn("head_sigs", signatures(F.col("head_text")))
    links = spark.createDataFrame([(b, h) for b, h in after.items()], "bucket int, doc_id long")
    first = links.join(first, F.col("doc_id").eqNullSafe(F.col("head"))).select("bucket", "head_text", "head_sigs")
    rows = rows.join(first, "bucket", "left").select(
        "doc_id", "text", "sigs", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_sigs", "head_sigs").alias("next_sigs"), F.char_length("text").alias("n")
    )
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
