"""A corpus pipeline: quality classifier, quality rules, one document of each near-duplicate group, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. Nulls: a null text counts as an empty one, which the quality rules reject. Repeated
rows are judged alike; of equal ones the third stage keeps one. Stages two and three judge rows, not doc_ids: rows with a
null or repeated doc_id stay or go by their own texts. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.llm.common import Scratch
from brookline.llm.ngram_join import ngram_jaccard_join
from brookline.llm.packing import pack_documents
from brookline.llm.quality_model import scores, train
from brookline.llm.quality_rules import cleaned

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is at least 0.5; learns from all labels of documents still there."""
    docs = docs.select(*COLUMNS)
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(scores(forest), schema).where("score >= 0.5").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that pass the base rules and aren't depleted, without their boilerplate lines; n_chars follows."""
    n_chars = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cleaned(docs.select(*COLUMNS)).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links connect: the one of least doc_id, null ones last, ties by position."""
    rows = Scratch(spark, "near-duplicates").table(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = ngram_jaccard_join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min(order).alias("least")).select("least.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("packing", packing)]

#: SQL cannot express the classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
    return docs
