"""Blocks of lines that the documents of a host share."""

import numpy as np
import pytest

from brookline.llm import quality_rules

SCHEMA = "doc_id long, text string, source string"


def line(r, n=12):
    return " ".join(f"w{k}" for k in r.integers(0, 10**6, n))


@pytest.mark.parametrize("place", ["start", "middle", "end"])
def test_shared_block(spark, place):
    r = np.random.default_rng(8)
    block = "\n".join(line(r, 15) for _ in range(10))

    def text(k):
        own = [line(r) for _ in range(k)]
        at = {"start": 0, "middle": k // 2, "end": k}[place]
        return "\n".join([*own[:at], block, *own[at:]])

    rows = [(i, text(5), "h") for i in range(60)] + [(100 + i, text(20), "h") for i in range(60)]
    copy = "\n".join(line(r) for _ in range(8))
    rows += [(200 + i, copy if i % 2 else copy.upper().replace(" ", "  "), "h") for i in range(60)]
    found = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i].removed_words == 150 and not found[i].kept for i in range(60))  # 60 of 210 words left
    assert all(found[100 + i].removed_words == 150 and found[100 + i].kept for i in range(60))
    assert all(found[200 + i].removed_words == 0 and found[200 + i].kept for i in range(60))


def test_cleaned_text(spark):
    import corpus_pipeline as p

    r = np.random.default_rng(9)
    block = [line(r) for _ in range(4)]
    own = [[line(r) for _ in range(9)] for _ in range(60)]
    text = lambda k: "\n".join(["", *own[k][:4], block[0].upper(), *block[1:], "é " + own[k][4], " ", *own[k][5:], block[0]])
    rows = [(k, text(k), "en", "h", len(text(k))) for k in range(60)] + [(100, "\n".join(own[0]), "en", "other", 7), (None, text(3), "en", "h", 1), (100, block[0], "en", "other", 1)]
    got = p.rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    want = ["\n".join(["", *x[:4], "é " + x[4], " ", *x[5:]]) for x in own]
    assert sorted(r.text for r in got) == sorted([*want, want[3], "\n".join(own[0])])
    assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in got if r.doc_id is not None and r.doc_id < 60)
    assert [(r.text, r.n_chars) for r in got if r.doc_id == 100] == [("\n".join(own[0]), 7)]
    assert [r.text for r in got if r.doc_id is None] == [want[3]]
