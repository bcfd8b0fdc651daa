"""Licence scan with DataFrame functions only: Dice coefficient over word bigrams.

A document's units are its lines, the whole text, and windows of words across line ends, as long as a template (less
what would lie before the text's first word or after its last one): for notices where no line (nor the whole text) is
similar already, for full licence texts (``licence_texts``) wherever they stand. A unit is compared to a template only
if the sizes of their bigram sets allow the similarity (the size bounds of the Dice coefficient). Before that, a unit
must hold one of a few key words: of a template's b bigrams a similar unit misses less than a third, so any choice of
that many bigrams is hit, and a word of each of them serves as its key. Texts without a key are dropped before any
bigram is made.

Key bigrams are chosen in the same way. For a notice every window that holds one is compared, which are all that can
be similar. A full licence text is looked for where its key bigrams and enough of its others occur, at every start: the
counts of a window follow from those of the one before, and a stretch of starts is left out only if its first window
lacks more than so many steps can add.
The SQL below is as first given: it has the notices as templates, and lines and the whole text as units.
"""

from __future__ import annotations

import json
import math
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

DICE = 0.8
#: Licence notices by SPDX-like name; a licence may have several. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
#: Full licence texts, by name.
FULL_TEXTS = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
WINDOWED = "array<struct<name: string, full: boolean, words: int, n: int, low: double, high: double, keys: array<string>, grams: array<string>, dealt: array<array<string>>>>"


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, dice: float) -> tuple[float, float]:
    """The sizes of sets that can reach the coefficient with a set of n."""
    return n * dice / (2 - dice), n * (2 - dice) / dice


def spare(n: int, dice: float) -> int:
    """Of n bigrams, any choice of so many holds one of every similar unit."""
    return n - math.ceil(dice * (math.ceil(size_bounds(n, dice)[0] - 1e-9) + n) / 2 - 1e-9) + 1


def key_words(known: list[tuple[str, list[str]]], dice: float) -> list[str]:
    """Words of which every unit similar to a template holds one."""
    keys = set()
    for _, bigrams in known:
        longest = sorted((max(b.split(), key=len) for b in bigrams), key=lambda w: (-len(w), w))
        keys.update(longest[: spare(len(bigrams), dice)])
    return sorted(k for k in keys if not any(o != k and o in k for o in keys))


def more_keys(full: list[list[str]], keys: list[str], dice: float) -> list[str]:
    """``keys`` and further words, such that every unit similar to a full text holds one."""
    keys = list(keys)
    for bigrams in full:
        left = [b for b in bigrams if not any(k in b for k in keys)]
        while len(bigrams) - len(left) < spare(len(bigrams), dice):
            words = [w for b in left for w in set(b.split())]
            keys.append(max(words, key=lambda w: (len(w) > 6, words.count(w), w)))
            left = [b for b in left if keys[-1] not in b]
    return keys


def windowed(name: str, text: str, full: bool, dice: float) -> dict:
    """A template for windows, with its key bigrams; those of a full text also dealt by checksum, to be looked up."""
    words = template_words(text)
    bigrams = bigrams_of(words)
    keys = sorted(bigrams, key=lambda b: (-max(map(len, b.split())), b))[: spare(len(bigrams), dice)]
    low, high = size_bounds(len(bigrams), dice)
    dealt = [[] for _ in bigrams if full]
    for b in bigrams if full else []:
        dealt[zlib.crc32(b.encode()) % len(dealt)].append(b)
    return {"name": name, "full": full, "words": len(words), "n": len(bigrams), "low": low - 1e-9, "high": high + 1e-9, "keys": keys, "grams": bigrams, "dealt": dealt}


def normalised(text: Column) -> Column:
    """Words of a-z and 0-9 of a lower-cased text, one space between."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def once(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def window_at(score: Column, t: Column, start: Column) -> Column:
    return F.struct(score.alias("dice"), t["name"].alias("name"), t.full.alias("full"), start.alias("start"), (start + t.words).alias("end"))


def part(pairs: Column, start: Column, n: Column) -> Column:
    """n bigrams from a start, which may lie before the first: those that there are."""
    return F.slice(pairs, F.greatest(start, F.lit(0)) + 1, n + F.least(start, F.lit(0)))


def windows(pairs: Column, marks: Column, known: Column, dice: float) -> Column:
    """(dice, name, full, start, end) of the similar windows. pairs: bigrams of a text; marks: (b, i) of key bigrams there."""

    def of(t: Column) -> Column:
        own = F.filter(marks, lambda x: F.array_contains(t.keys, x.b))
        starts = F.array_distinct(F.flatten(F.transform(own, lambda x: F.sequence(x.i + 2 - t.words, x.i))))

        def compared(start: Column) -> Column:
            own = F.array(F.array_distinct(part(pairs, start, t.words - 1)))
            score = F.transform(own, lambda w: F.when((F.size(w) >= t.low) & (F.size(w) <= t.high), 2.0 * F.size(F.array_intersect(w, t.grams)) / (F.size(w) + t.n)).otherwise(0.0))[0]
            return window_at(score, t, start)

        return F.filter(F.transform(starts, compared), lambda x: x.dice >= dice)

    return F.flatten(F.transform(known, of))


def neighbours(pairs: Column) -> Column:
    """(i, b, before, after) of each position: its bigram and where the same one stands before (else -1) and after it (else the largest int)."""

    def beside(by_bigram: Column) -> Column:
        def at(x: Column, k: Column) -> Column:
            before, after = F.get(by_bigram, k - 1), F.get(by_bigram, k + 1)
            return F.struct(x.i.alias("i"), x.b.alias("b"), F.when(before.b == x.b, before.i).otherwise(-1).alias("before"), F.when(after.b == x.b, after.i).otherwise(2**31 - 1).alias("after"))

        return F.transform(by_bigram, at)

    return F.sort_array(once(F.sort_array(F.transform(pairs, lambda x, i: F.struct(x.alias("b"), i.alias("i")))), beside))


def full_windows(pairs: Column, known: Column, dice: float) -> Column:
    """As ``windows``, of every start, in stretches of starts."""
    none = F.filter(F.array(F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name"), F.lit(True).alias("full"), F.lit(0).alias("start"), F.lit(0).alias("end"))), lambda x: F.lit(False))

    def of(t: Column, places: Column) -> Column:
        wide = t.words - 1  # bigrams of a window
        stretch = F.greatest((t.words / 4).cast("int"), F.lit(2))

        def scanned(theirs: Column) -> Column:  # whether the template has the bigram of a place
            def step(have: Column, start: Column) -> Column:
                left, come = F.get(places, start - 1), F.get(places, start + wide - 1)
                minus, plus = F.coalesce(left.after >= start + wide, F.lit(False)), F.coalesce(come.before < F.greatest(start - 1, F.lit(0)), F.lit(False))
                moved = F.struct(
                    (have["size"] + plus.cast("int") - minus.cast("int")).alias("size"),
                    (have.common + (plus & F.coalesce(F.get(theirs, start + wide - 1), F.lit(False))).cast("int") - (minus & F.coalesce(F.get(theirs, start - 1), F.lit(False))).cast("int")).alias("common"),
                )
                return once(moved, lambda x: F.struct(x["size"].alias("size"), x.common.alias("common"), F.concat(have.found, similar(x["size"], x.common, start)).alias("found")))

            def similar(size: Column, common: Column, start: Column) -> Column:
                score = 2.0 * common / (size + t.n)
                return F.when(score >= dice, F.array(window_at(score, t, start))).otherwise(none)

            def from_first(first: Column) -> Column:
                def go(own: Column) -> Column:
                    common = F.size(F.array_intersect(own, t.grams))
                    # A step adds one at most to what is common less dice / 2 of the size.
                    near = common - dice / 2 * F.size(own) + stretch >= dice / 2 * t.n
                    begin = F.struct(F.size(own).alias("size"), common.alias("common"), similar(F.size(own), common, first).alias("found"))
                    return F.when(near, F.aggregate(F.sequence(first + 1, first + stretch - 1), begin, step).found).otherwise(none)

                return once(F.array_distinct(part(pairs, first, wide)), go)

            return F.flatten(F.transform(F.sequence(1 - wide, F.size(places) - 1, stretch), from_first))

        return once(F.transform(places, lambda x: F.array_contains(F.get(t.dealt, (F.crc32(x.b) % t.n).cast("int")), x.b)), scanned)

    return F.when(F.size(known) > 0, once(neighbours(pairs), lambda places: F.flatten(F.transform(known, lambda t: of(t, places))))).otherwise(none)


def apart(found: Column, taken: Column) -> Column:
    """Windows, best first (full texts before notices), that overlap none before and, of notices, no taken (start, end)."""
    first = lambda x, y: F.when(x.full != y.full, F.when(x.full, -1).otherwise(1)).when(x.dice != y.dice, F.when(x.dice > y.dice, -1).otherwise(1)).when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1)).when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0)
    free = F.filter(found, lambda x: x.full | ~F.exists(taken, lambda y: (x.start < y.end) & (y.start < x.end)))
    return F.aggregate(F.array_sort(free, first), F.filter(found, lambda x: F.lit(False)), lambda have, x: F.when(F.exists(have, lambda y: (x.start < y.end) & (y.start < x.end)), have).otherwise(F.concat(have, F.array(x))))


def scan_licenses(docs: DataFrame, dice: float = DICE, templates: tuple = TEMPLATES, full_texts: tuple = FULL_TEXTS) -> DataFrame:
    """(doc_id, n_units, licenses, best_license, best_dice) of every row.

    n_units: units with a template at or above ``dice``, of windows those that overlap no better one; licenses: the names found, ascending, joined by commas (empty
    if none; of windows the names of the closest template and of verbatim notices); best_license, best_dice: of the closest template, ties by name, null if none. A null text has no units.
    Several bigrams that are equal count once. Other columns are ignored; an empty table gives an empty result.
    """
    known = [(name, bigrams_of(template_words(text))) for name, text in templates]
    keys = key_words(known, dice)
    across = [windowed(name, text, False, dice) for name, text in templates] + [windowed(name, text, True, dice) for name, text in full_texts]
    text_keys = more_keys([t["grams"] for t in across if t["full"]], keys, dice)

    def has_key(lowered: Column) -> Column:
        return holds(lowered, keys)

    def holds(lowered: Column, keys: list[str]) -> Column:
        found = F.lit(False)
        for k in keys:
            found = found | F.contains(lowered, F.lit(k))
        return found

    def bigrams(unit: Column) -> Column:
        words = F.split(unit, " ")
        pairs = F.transform(F.array(words), lambda w: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.element_at(w, i + 2))))
        return F.array_distinct(pairs[0])

    def compared(own: Column) -> Column:
        found = []
        for name, theirs in known:
            low, high = size_bounds(len(theirs), dice)
            common = F.size(F.array_intersect(own, F.lit(theirs)))
            score = 2.0 * common / (F.size(own) + F.lit(len(theirs)))
            found.append(F.struct(F.when((F.size(own) >= low) & (F.size(own) <= high), score).otherwise(0.0).alias("dice"), F.lit(name).alias("name")))
        return F.filter(F.array(*found), lambda x: x.dice >= dice)

    def hits(unit: Column) -> Column:
        return F.transform(F.array(bigrams(unit)), compared)[0]

    lowered = F.lower("text")
    none = F.array().cast("array<string>")
    rows = documents(docs).select("doc_id", F.when(holds(lowered, text_keys), lowered).alias("lowered"))
    rows = rows.withColumn("lines", F.coalesce(F.split("lowered", "\n"), none)).withColumn("words", F.coalesce(F.split(normalised(F.col("lowered")), " "), none))
    rows = rows.withColumn("pairs", F.transform(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.element_at("words", i + 2))))
    nothing = F.array().cast("array<struct<dice: double, name: string>>")
    lines = F.transform(F.filter("lines", has_key), normalised)
    rows = rows.withColumn("hits", F.filter(F.transform(F.filter(lines, lambda x: F.locate(" ", x) > 0), hits), lambda x: F.size(x) > 0))
    rows = rows.withColumn("whole", F.when((F.size("lines") > 1) & (F.size("pairs") > 0), F.transform(F.array(F.array_distinct("pairs")), compared)[0]).otherwise(nothing))
    notices, texts = (F.from_json(F.lit(json.dumps([t for t in across if t["full"] == full])), WINDOWED) for full in (False, True))
    all_keys = F.split(F.lit("|".join(sorted({k for t in across for k in t["keys"]}))), r"\|")
    rows = rows.withColumn("present", F.array_intersect("pairs", all_keys))
    marks = F.filter(F.transform("pairs", lambda x, i: F.struct(x.alias("b"), i.alias("i"))), lambda x: F.array_contains("present", x.b))
    no_window = F.array().cast("array<struct<dice: double, name: string, full: boolean, start: int, end: int>>")
    rows = rows.withColumn("marks", F.when(F.size("present") > 0, marks).otherwise(F.array().cast("array<struct<b: string, i: int>>")))
    possible = F.filter(texts, lambda t: F.arrays_overlap("present", t.keys) & (F.size(F.array_intersect("pairs", t.grams)) >= t.low))
    found = F.concat(windows(F.col("pairs"), F.col("marks"), notices, dice), once(possible, lambda t: full_windows(F.col("pairs"), t, dice)))
    rows = rows.withColumn("near", F.when(F.size("marks") > 0, found).otherwise(no_window))

    # Where lines with a similar template stand among the words.
    def place(have: Column, line: Column) -> Column:
        unit = normalised(line)
        end = have.at + F.when(unit == "", 0).otherwise(F.size(F.split(unit, " ")))
        found = F.when(has_key(line) & (F.locate(" ", unit) > 0), F.size(hits(unit))).otherwise(0)
        return F.struct(end.alias("at"), F.when(found > 0, F.concat(have.taken, F.array(F.struct(have.at.alias("start"), end.alias("end"))))).otherwise(have.taken).alias("taken"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("taken"))
    everything = F.array(F.struct(F.lit(0).alias("start"), F.size("words").alias("end")))
    taken = F.when(F.size("whole") > 0, everything).when((F.size("hits") > 0) & (F.size("near") > 0), F.aggregate("lines", start, place).taken).otherwise(start.taken)
    rows = rows.withColumn("taken", taken).withColumn("apart", F.when(F.size("near") > 0, apart(F.col("near"), F.col("taken"))).otherwise(no_window))
    same = lambda x, y: (x.start == y.start) & (x.end == y.end) & (x.dice == y.dice)
    closest = F.filter("near", lambda x: (x.dice == 1.0) | F.exists("apart", lambda y: same(x, y)))
    plain = F.transform(closest, lambda x: F.struct(x.dice.alias("dice"), x["name"].alias("name")))
    rows = rows.withColumn("flat", F.concat(F.flatten("hits"), F.col("whole"), plain))
    best = F.array_sort("flat", lambda x, y: F.when(x.dice > y.dice, -1).when(x.dice < y.dice, 1).when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0))
    n_units = F.size("hits") + (F.size("whole") > 0).cast("int") + F.size("apart")
    rows = rows.select("doc_id", n_units.cast("long").alias("n_units"), F.array_join(F.array_sort(F.array_distinct(F.transform("flat", lambda x: x["name"]))), ",").alias("licenses"), F.get(best, F.lit(0)).alias("best"))
    return rows.select("doc_id", "n_units", "licenses", F.col("best.name").alias("best_license"), F.col("best.dice").alias("best_dice"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(dice: float = DICE, templates: tuple = TEMPLATES) -> str:
    """DuckDB SQL for the rows of the query."""
    known = []
    for k, (name, text) in enumerate(templates):
        bigrams = bigrams_of(template_words(text))
        low, high = size_bounds(len(bigrams), dice)
        known.append(f"({k}, '{name}', [{', '.join(repr(b) for b in bigrams)}], {low!r}::double, {high!r}::double)")
    return f"""WITH template(k, name, theirs, low, high) AS (VALUES {', '.join(known)}),
unit AS (SELECT doc_id, unnest(list_concat(string_split(lower(text), chr(10)), CASE WHEN contains(text, chr(10)) THEN [lower(text)] ELSE [] END)) AS u FROM documents),
word AS (SELECT row_number() OVER () AS id, doc_id, string_split(trim(regexp_replace(u, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM unit),
own AS (SELECT id, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM word WHERE len(w) > 1),
hit AS (SELECT id, doc_id, name, 2.0::double * len(list_intersect(own, theirs)) / (len(own) + len(theirs)) AS dice FROM own JOIN template ON len(own) BETWEEN low AND high),
found AS (SELECT * FROM hit WHERE dice >= {dice}::double),
best AS (SELECT doc_id, count(DISTINCT id) AS n_units, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, arg_min(name, (-dice, name)) AS best_license, max(dice) AS best_dice FROM found GROUP BY 1)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses, best_license, best_dice FROM documents d LEFT JOIN best USING (doc_id)"""
