"""Document rules, and the frequency of lines across the documents of a host.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted. A line is
boilerplate if more than LEAST_DOCUMENTS distinct documents of its host hold it and more than SHARE of the host's
distinct documents do, wherever it stands in them. Documents with equal normalised lines in the same order are copies
and count once (removing copies is another operator's work); near copies with other words are documents of their own.
Boilerplate lines are removed, and a document that keeps less than KEEP of its words is depleted and rejected.
Counting is pre-aggregated in each task, so a line that a third of all rows hold costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RADIX, Scratch, _power, mix
from .text_stats import SYMBOL, slices_of

LEAST_DOCUMENTS, SHARE, KEEP = 20, 0.001, 0.5
LINE = pa.struct([("h", pa.int64()), ("w", pa.int32())])
BASE = "host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<struct<h: long, w: int>>"


def base_rules(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the columns before ``text``, and BASE of whole texts. content: a hash of the normalised lines in order; lines: each distinct one with all its words."""
    for batch in rows:
        first_columns = batch.schema.names[: batch.schema.names.index("text")]
        for start, end, s in slices_of(batch.column("text")):
            row, exact, normal, words, _ = s.lines()
            twice = np.bincount(row, weights=s.earlier_lines(row, exact), minlength=s.rows).astype(np.int64) if len(row) else np.zeros(s.rows, np.int64)
            n_lines = np.bincount(row, minlength=s.rows)
            sums = np.zeros(s.rows, np.uint64)
            np.add.at(sums, row, normal * _power(RADIX, len(row))[np.arange(len(row)) - (np.cumsum(n_lines) - n_lines)[row]])
            content = mix(sums + n_lines.astype(np.uint64)).view(np.int64)
            normal = normal.view(np.int64)
            order = np.lexsort((np.arange(len(row)), normal, row))
            new = np.ones(len(order), bool)
            new[1:] = (row[order[1:]] != row[order[:-1]]) | (normal[order[1:]] != normal[order[:-1]])
            at = np.flatnonzero(new)
            total = np.add.reduceat(words[order], at) if len(at) else np.zeros(0)
            first = order[at]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=s.rows))))
            items = pa.StructArray.from_arrays([pa.array(normal[first]), pa.array(total.astype(np.int32))], fields=list(LINE))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
            counts = [pa.array(x.astype(np.int64)) for x in (s.n_words, s.word_chars(), s.letters(SYMBOL), twice, s.repeated_words())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, end - start) for c in [*first_columns, "host"]), *counts, pa.array(content), lists], [*first_columns, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines"])


def without_lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: ``text`` without the lines whose hashes stand in ``gone``; the other columns as they are."""
    for batch in rows:
        column, gone = batch.column("text"), batch.column("gone")
        at = np.flatnonzero((gone.is_valid().to_numpy(zero_copy_only=False)) & (np.asarray(pc.fill_null(pc.list_value_length(gone), 0)) > 0))
        new = {}
        texts = column.take(pa.array(at))
        for start, end, s in slices_of(texts):
            row, _, normal, _, _ = s.lines()
            normal, bounds = normal.view(np.int64), np.searchsorted(row, np.arange(s.rows + 1))
            for k in range(start, end):
                hashes, drop = iter(normal[bounds[k - start] : bounds[k - start + 1]].tolist()), set(gone[int(at[k])].as_py())
                lines = texts[k].as_py().encode().split(b"\n")
                new[int(at[k])] = b"\n".join(x for x in lines if not (x.strip() and next(hashes) in drop)).decode()
        if new:
            mask = np.zeros(len(column), bool)
            mask[at] = True
            column = pc.replace_with_mask(column, pa.array(mask), pa.array([new[k] for k in at.tolist()], column.type))
        names = [n for n in batch.schema.names if n != "gone"]
        yield pa.RecordBatch.from_arrays([column if n == "text" else batch.column(n) for n in names], names)


def boilerplate_lines(lines: DataFrame, hosts: DataFrame, least: int, share: float) -> DataFrame:
    """(host, h) of the lines above the limits. lines: (host, h, content), one row a document; hosts: (host, docs)."""
    found = lines.select("host", "h", "content").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return found.join(hosts, "host").where(F.col("n") > share * F.col("docs")).select("host", "h")


def judged(docs: DataFrame, column: str, least: int, share: float, keep: float) -> DataFrame:
    """``column`` and the figures of each row; gone: the hashes of its boilerplate lines, null if there are none."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    docs = docs.select(column, F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("source"), F.lit("")).alias("host"))
    schema = T.StructType([docs.schema[column], *T._parse_datatype_string(BASE).fields])
    base = scratch.table(docs.mapInArrow(base_rules, schema).withColumn("row", F.monotonically_increasing_id()), "base")
    lines = base.select("row", "host", "content", F.explode("lines").alias("l")).select("row", "host", "content", "l.*")
    hosts = base.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    common = scratch.table(boilerplate_lines(lines, hosts, least, share), "boilerplate")
    lost = lines.join(common, ["host", "h"]).groupBy("row").agg(F.sum("w").alias("removed_words"), F.collect_list("h").alias("gone"))
    out = base.drop("lines", "content").join(lost, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return out.select(column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_words", (~failed & (left >= keep * F.col("n_words"))).alias("kept"), "gone")


def quality_rules(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept) of each row.

    The host is ``source``; a null one counts as the empty string. A null or empty text has no words and fails the base
    rules. Repeated rows are judged alike and count once. Other columns are ignored; an empty table gives an empty
    result.
    """
    return judged(docs, "doc_id", least, share, keep).drop("gone")


def cleaned(docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """The kept rows with all their columns, boilerplate lines removed from ``text``, and removed_words.

    The verdict is each row's own, so null and repeated doc_ids are judged by their texts. Lines go with their line
    ends; the text is otherwise as it was.
    """
    kept = judged(docs.select(F.struct("*").alias("doc"), "source", "text"), "doc", least, share, keep).where("kept")
    rows = kept.select("doc.*", "removed_words", "gone")
    return rows.mapInArrow(without_lines, T.StructType([*docs.schema.fields, T.StructField("removed_words", T.LongType())]))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the query."""
    word = r"'[^\x20\x09-\x0D]+'"
    lower = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
tri AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
again AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY 1),
line AS (SELECT r, host, i, l, array_to_string(regexp_extract_all({lower}, {word}), ' ') AS h, len(regexp_extract_all(l, {word})) AS n FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) WHERE regexp_matches(l, {word})),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY 1),
content AS (SELECT d.r, d.host, md5(coalesce(string_agg(h, chr(10) ORDER BY i), '')) AS c FROM d LEFT JOIN line ON line.r = d.r GROUP BY 1, 2),
hosts AS (SELECT host, count(DISTINCT c) AS docs FROM content GROUP BY 1),
held AS (SELECT content.host, h, count(DISTINCT c) AS n FROM line JOIN content USING (r) GROUP BY 1, 2),
bad AS (SELECT host, h FROM held JOIN hosts USING (host) WHERE n > {LEAST_DOCUMENTS} AND n > {SHARE} * docs),
lost AS (SELECT r, sum(n)::bigint AS removed_words FROM line JOIN bad USING (host, h) GROUP BY 1),
o AS (SELECT doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
 FROM d LEFT JOIN dup USING (r) LEFT JOIN again USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {KEEP} * n_words AS kept FROM o"""
