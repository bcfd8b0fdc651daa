"""Null and repeated doc_ids in the third stage (the second: test_boilerplate.py)."""

import numpy as np


def test_near_duplicates(spark):
    import corpus_pipeline as p

    r = np.random.default_rng(3)
    text = lambda: " ".join(f"w{k}" for k in r.integers(0, 10**6, 80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a), (None, a + " more"), (7, b), (7, c), (5, c + " more"), (None, d), (9, d + " more"), (9, d + " more")]
    docs = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((x.doc_id or 0, x.text) for x in p.near_duplicates(spark, docs, "").collect()))
    assert [i for i, _ in got] == [0, 5, 7, 9]
    assert got[0][1] in (a, a + " more") and [t for _, t in got[1:]] == [c + " more", b, d + " more"]
