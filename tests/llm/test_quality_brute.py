"""Features and splits of the quality classifier against brute force."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from brookline.llm import quality_model
from brookline.llm.text_stats import FEATURES, features, slices_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "", None, " \n\t ", "one", "A b\nA b\nA b\n", "#*$%&|<>!?.;: (\"quoted\") it's well-known, isn't it?", "ÄÖ ß 日本語 naïve ½ 12345 word joined",
    "the cat sat the cat sat on\nThe Cat sat\n\n  the cat sat\r\nthe cat sat", "supercalifragilistic " * 30 + "\nend", "| a | b |\n| a | b |\n|---|---|",
]


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    letters, n = sum(map(len, words)), len(words)
    count = lambda of: sum(c in of for c in text)
    per = lambda part, whole: part / max(whole, 1)
    size = [len(w.encode()) for w in words]
    threes = list(zip(words, words[1:], words[2:], strict=False))
    often = collections.Counter(threes)
    repeated = {i + j for i, g in enumerate(threes) if often[g] > 1 for j in range(3)}
    lower = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words}
    return dict(
        words=math.log1p(n), word_length=per(letters, n), symbols=per(count("#*$%&|<>"), letters), upper=per(len(re.findall("[A-Z]", text)), letters), digits=per(len(re.findall("[0-9]", text)), letters),
        bars=per(count("|"), n), bangs=per(count("!"), n), stops=per(count(".?;:"), n), punctuation=per(count(",.;:!?'\"()-"), letters), wide=per(sum(c > "\x7f" for c in text), letters), repeated=per(len(repeated), n),
        repeated_lines=per(len(lines) - len(set(lines)), len(lines)), words_per_line=per(n, len(lines)), lines=math.log1p(len(lines)), distinct_words=per(len(lower), n), long_words=per(sum(s > 12 for s in size), n),
        short_words=per(sum(s <= 3 for s in size), n), longest_word=math.log1p(max(size, default=0)), longest_line=math.log1p(max((len(WORD.findall(x)) for x in lines), default=0)), spaces=per(len(re.findall(r"[\x20\x09-\x0D]", text)), letters),
    )


def test_features():
    r = np.random.default_rng(2)
    random = ["".join(r.choice(list("aAbé日 \n|!.7#\t"), k)) for k in r.integers(0, 200, 60)]
    texts = [t or "" for t in TEXTS] + random
    found = np.concatenate([features(s) for _, _, s in slices_of(pa.array(texts, pa.string()))])
    for text, row in zip(texts, found, strict=True):
        assert dict(zip(FEATURES, row, strict=True)) == pytest.approx(brute(text)), repr(text)


@pytest.mark.parametrize("seed", range(5))
def test_splits(seed):
    r = np.random.default_rng(seed)
    x = np.column_stack((r.normal(size=400), r.integers(0, 4, 400), np.zeros(400), r.exponential(size=400)))
    y = (x[:, 0] + x[:, 1] + r.normal(size=400) > 1.5).astype(float)
    feature, threshold, left, right, value, roots, start, _ = quality_model.fit(x, y, trees=1, depth=1, rate=1.0, bins=8)
    p = 1 / (1 + math.exp(-start))
    assert p == pytest.approx((y.sum() + 1) / (len(y) + 2))
    g, h = p - y, p * (1 - p)
    part = lambda rows: (g[rows].sum(), h * rows.sum())
    score = lambda rows: part(rows)[0] ** 2 / (part(rows)[1] + quality_model.RIDGE)
    gains = {}
    for f in range(x.shape[1]):
        for cut in np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1]):
            low = x[:, f] <= cut
            if min(part(low)[1], part(~low)[1]) >= quality_model.LEAST_HESSIAN:
                gains[f, float(cut)] = score(low) + score(~low)
    root = roots[0]
    assert gains[feature[root], threshold[root]] == pytest.approx(max(gains.values()))
    low = x[:, feature[root]] <= threshold[root]
    for node, rows in ((left[root], low), (right[root], ~low)):
        assert value[node] == pytest.approx(-part(rows)[0] / (part(rows)[1] + quality_model.RIDGE))
