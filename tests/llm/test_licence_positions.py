"""Windows of a licence scan against brute force over every start."""

import math
import random
import re

import pytest

from brookline.llm import licenses

FULL = {n: t for n, t in licenses.FULL_TEXTS if n in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT")}
KNOWN = [(n, licenses.template_words(t), full) for known, full in ((licenses.TEMPLATES, False), (FULL.items(), True)) for n, t in known]
COMMON = "some words of a row about nothing in particular to use and this software license copyright notice".split()


def words_of(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def dice(own, theirs):
    return 2.0 * len(own & theirs) / (len(own) + len(theirs))


def brute(text):
    """(n_units, licenses, best_license, best_dice)."""
    words, lines = words_of(text), text.split("\n")
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    flat, taken, at, n = [], [], 0, 0
    for unit in [*map(words_of, lines), words] if len(lines) > 1 else [words]:
        own, hits = set(licenses.bigrams_of(unit)), []
        for name, w, full in KNOWN:
            theirs = set(licenses.bigrams_of(w))
            low, high = licenses.size_bounds(len(theirs), licenses.DICE)
            if not full and own and low <= len(own) <= high and dice(own, theirs) >= licenses.DICE:
                hits.append((dice(own, theirs), name))
        at = 0 if unit is words else at
        taken += [(at, at + len(unit))] if hits else []
        flat, n, at = flat + hits, n + bool(hits), at + len(unit)
    near = []
    for name, w, full in KNOWN:
        theirs = set(licenses.bigrams_of(w))
        scores = [(dice(set(pairs[max(s, 0) : s + len(w) - 1]), theirs), s) for s in range(2 - len(w), len(pairs))]
        near += [(not full, -d, s, name, s + len(w)) for d, s in scores if d >= licenses.DICE]
    apart = []
    for x in sorted(near):
        spans = [(y[2], y[4]) for y in apart] + (taken if x[0] else [])
        if not any(x[2] < end and start < x[4] for start, end in spans):
            apart.append(x)
    flat += [(-x[1], x[3]) for x in near if x[1] == -1.0 or any((x[1], x[2], x[4]) == (y[1], y[2], y[4]) for y in apart)]
    best = min(((-d, name) for d, name in flat), default=(None, None))
    return n + len(apart), ",".join(sorted({name for _, name in flat})), best[1], best[0] and -best[0]


def prose(r, n):
    return " ".join(r.choices(COMMON, k=n))


def halves(text):
    words = text.split()
    return " ".join(words[len(words) // 2 :] + words[: len(words) // 2])


def edited(r, text, share=0.03):
    parts = [x for x in re.split(r"(\s+)", text) if x.isspace() or r.random() > share]
    return "".join(x if x.isspace() or r.random() > share else f"{x} {r.choice(COMMON)}" for x in parts)


R = random.Random(7)
CASES = {
    "last words first": f"{prose(R, 150)}\n{halves(FULL['MIT'])}\n{prose(R, 150)}",
    "paragraphs in reverse": f"{prose(R, 150)}\n" + "\n\n".join(FULL["ISC"].split("\n\n")[::-1]) + f"\n{prose(R, 150)}",
    "many edits": f"{prose(R, 333)}\n{edited(R, FULL['Apache-2.0'])}\n{prose(R, 99)}",
    "a line that is a notice": f"{prose(R, 50)}\n" + "\n".join(x.replace("\n", " ") for x in FULL["BSD-2-Clause"].replace("disclaimer", "note").split("\n\n")) + f"\n{prose(R, 50)}",
    "in a similar text": "This work is licensed under the GNU\nGeneral Public License, version 3. All rights\nreserved.",
    "as few as can be": f"{prose(R, 30)}\nThis work is licensed under\nthe GNU Lesser General",
    "two": f"{FULL['MIT']}\n{FULL['MIT']}",
    "cut": FULL["BSD-3-Clause"][: len(FULL["BSD-3-Clause"]) * 7 // 10],
    "cut before": f"{FULL['BSD-3-Clause'][len(FULL['BSD-3-Clause']) * 3 // 10 :]}\n{prose(R, 150)}",
    "a notice cut before": f"under the MIT\nLicense {prose(R, 20)}",
    "only a notice": "Licensed under the Apache License,\nVersion 2.0.",
} | {f"random {i}": f"{prose(R, R.randrange(90))}\n{edited(R, R.choice((str, halves))(FULL[R.choice(sorted(FULL))]), i / 100)} {prose(R, R.randrange(90))} {R.choice(licenses.TEMPLATES)[1]}" for i in range(1, 16)}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(enumerate(CASES.values())), "doc_id long, text string").repartition(4)
    return {r.doc_id: r for r in licenses.scan_licenses(docs, full_texts=tuple(FULL.items())).collect()}


@pytest.mark.parametrize("case", CASES)
def test_every_start(found, case):
    r, (n, names, best, score) = found[list(CASES).index(case)], brute(CASES[case])
    assert (r.n_units, r.licenses, r.best_license) == (n, names, best)
    assert r.best_dice is score is None or math.isclose(r.best_dice, score, abs_tol=1e-12)


def test_found_at_all(found):
    names = {case: found[i].licenses.split(",") for i, case in enumerate(CASES)}
    assert "ISC" in names["paragraphs in reverse"] and "BSD-2-Clause" in names["a line that is a notice"]
    assert "BSD-3-Clause" in names["cut before"] and "MIT" in names["a notice cut before"]
    assert "Proprietary" in names["in a similar text"] and "LGPL-3.0" in names["as few as can be"]
