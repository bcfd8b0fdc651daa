"""The operators against brute force, exact round trips and held-out accuracy, with nulls, ties and odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookline.llm import bpe, katz, language, licenses, ngram_join, packing, quality_model, quality_rules, spotsigs, token_orc
from brookline.llm.pretokens import default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=160):
    """Random texts, copies and near copies of some, odd ones, a shared passage and a repeated row."""
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdeé"), r.integers(2, 7))) for _ in range(300)] + ["The", "of", "and", "is"] * 20
    text = lambda k: "".join(w + ("\n" if r.random() < 0.1 else " ") for w in r.choice(vocabulary, k))
    passage = text(60)
    texts = ["", None, " \n\t", "one", "one two", "One  two", "a b c d", "日本語 テスト 😀", "x" * 5000, "<|endoftext|> it's 12 <|"]
    texts += [text(int(k)) for k in r.integers(5, 400, n)]
    for k in range(40):
        words = WORD.findall(texts[10 + k % 12])
        for _ in range(k % 4):
            if words:
                words[r.integers(len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [f"{passage} {text(20)}" for _ in range(12)] + [passage] * 5
    rows = [(7 * i + 3, t, ["en", "de", None][i % 3], ["h0", "h0", None][i % 3], 1) for i, t in enumerate(texts)]
    return [*rows, rows[20]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return extra.withColumns({"node": F.lit("clash"), "score": F.lit(1), "start": F.lit(None).cast("string"), "key": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=75):
    sets = {d: shingle_set(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("frequent", "chunk", "percent"), [(32, 10**6, 75), (1, 500, 75), (1, 900, 51), (2, 500, 90)])
def test_join_is_exact(docs, rows, frequent, chunk, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", frequent)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "PART", 1000)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    found = ngram_join.ngram_jaccard_join(docs, percent=percent).collect()
    want = brute_components(rows, percent)
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_signature_bound_holds():
    r = np.random.default_rng(5)
    pool = np.sort(r.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    for _ in range(100):
        x, y = (np.sort(r.choice(pool, r.integers(1, 900), replace=False)) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert both <= ngram_join.most_common_tokens(ngram_join.signature(x), ngram_join.signature(y), len(x), len(y))


def test_join_of_nothing(none):
    assert ngram_join.ngram_jaccard_join(none).collect() == []
    spark = none.sparkSession
    only = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles) for r in ngram_join.ngram_jaccard_join(only).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_katz_is_normalised_and_right(docs, rows, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 20_000)
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    found = collections.defaultdict(list)
    for r in katz.katz_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect():
        found[r.doc_id].append(r)
    tokens = [(d, [*WORD.findall((t or "").translate(LOWER)), "\0end"]) for d, t, *_ in rows]
    c1, c2, ch = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in tokens:
        if not held(d):
            c1.update(t)
            c2.update(zip(["\0begin", *t], t, strict=False))
            ch.update(["\0begin", *t][:-1])
    counts = lambda c: np.array([sum(v == k for v in c.values()) for k in range(1, 7)], np.int64)
    d1, d2, n = katz.discounts(counts(c1)), katz.discounts(counts(c2)), sum(c1.values())
    unknown = 1 - sum(d1[min(v, 6)] * v / n for v in c1.values())
    p1 = lambda w: d1[min(c1[w], 6)] * c1[w] / n if w in c1 else unknown
    seen, words = collections.defaultdict(float), collections.defaultdict(float)
    for (h, w), v in c2.items():
        seen[h] += d2[min(v, 6)] * v / ch[h]
        words[h] += p1(w)
    alpha = {h: (1 - seen[h]) / (1 - words[h]) for h in seen}
    p2 = lambda h, w: d2[min(c2[h, w], 6)] * c2[h, w] / ch[h] if (h, w) in c2 else alpha.get(h, 1.0) * p1(w)
    for h in [*list(ch)[:20], "\0begin"]:
        assert abs(sum(p2(h, w) for w in c1) + alpha[h] * unknown - 1) < 1e-9
    for d, t in tokens:
        for r in found[d]:
            assert math.isclose(r.score, sum(math.log10(p2(h, w)) for h, w in zip(["\0begin", *t], t, strict=False)), rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(r.base_score, sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (len(c1) + 1))) for w in t), rel_tol=1e-9)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(t), sum(w in c1 for w in t), n)
    assert sum(map(len, found.values())) == len(rows)


def test_katz_of_nothing(none, spark):
    assert katz.katz_scores(none, F.lit(False)).collect() == []
    only = katz.katz_scores(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert sorted((r.n_tokens, r.doc_id, r.n_known, r.score) for r in only) == [(1, None, 0, 0.0), (3, 1, 0, 0.0)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_as_the_library(docs, rows, library, none):
    want = collections.Counter((d, np.array(i := library_ids(library, t), "<u4").tobytes(), library.decode(i, skip_special_tokens=False)) for d, t, *_ in rows)
    got = collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded).decode()) for r in bpe.bpe_encode(docs).collect())
    assert got == want
    assert bpe.bpe_encode(none).collect() == []


def test_bpe_of_any_characters(library):
    encoder, r = bpe.PairIndexEncoder(default_path()), np.random.default_rng(3)
    texts = ["".join(map(chr, r.choice([*range(1, 0x300), *range(0x370, 0x400), 0x4E2D, 0x1F600, 0x301, 0xFFFD], 40))) for _ in range(300)]
    texts += ["aaaaaaa aaa", "don't I'LL WE'VE", "İΣΑΣς ŉ", "\x1c\x1d \x85\xa0 x", "<|endoftext|><|startoftext|>a"]
    for (ids, decoded), t in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (want := library_ids(library, t))
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_orc_round_trip(docs, rows, library, none, tmp_path, spark):
    path = token_orc.write_token_orc(docs, f"file://{tmp_path}/ids", files=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in token_orc.read_token_orc(spark, path).collect())
    start, want = 0, []
    for d, t in sorted(((d, t or "") for d, t, *_ in rows)):
        ids = [*library_ids(library, t), 1]
        want.append((d, start, len(ids), ids))
        start += len(ids)
    assert got == want
    assert [r.n_tokens for r in token_orc.find_tokens(spark, path, rows[3][0]).collect()] == [2]
    assert "doc_id" in token_orc.find_tokens(spark, path, 5)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert token_orc.read_token_orc(spark, token_orc.write_token_orc(none, f"file://{tmp_path}/none", files=2)).collect() == []


def test_packing(docs, rows, library, none):
    want = collections.Counter((d, np.array([*library_ids(library, t), 1], "<u4").tobytes()) for d, t, *_ in rows)
    found = packing.pack_documents(docs, window=256).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.Counter()
    ids = {d: b for d, b in want}
    for r in found:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids[r.doc_id]) // 4
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    assert by_doc == collections.Counter({d: sum(len(b) // 4 * n for (e, b), n in want.items() if e == d) for d, _ in want})
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(by_doc.values()) / (256 * len(by_sequence)) > 0.9
    assert packing.pack_documents(none).collect() == []


def test_best_fit_is_best_fit():
    r = np.random.default_rng(2)
    lengths = sorted(r.integers(1, 101, 500).tolist(), reverse=True)
    where, offset, used = packing.best_fit_decreasing(lengths, 100)
    fill = []
    for length, w, o in zip(lengths, where, offset, strict=True):
        fits = [100 - f for f in fill if f and 100 - f >= length]
        if fits and length < 100:
            assert 100 - fill[w] == min(fits)
        else:
            assert w == len(fill)
            fill.append(0)
        assert fill[w] == o
        fill[w] += length
    assert used == len(fill)


def base_rules(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if c[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_rules(docs, rows, none):
    want = collections.Counter((d, *base_rules(t)) for d, t, *_ in rows)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs).collect())
    assert got == want
    assert quality_rules.quality_rules(none).collect() == []


def test_line_frequency(spark):
    r = np.random.default_rng(4)
    line = lambda: " ".join(f"w{k}" for k in r.integers(0, 10**6, 12))
    texts = [(i, "\n".join([line() for _ in range(6)] + ["Click  HERE to subscribe now"]), "h") for i in range(60)]  # clean, with a footer
    texts += [(100 + i, "\n".join([f"{line()} {i}"] + ["click here to subscribe NOW", "ab " * 3 + "all rights and other menu words that fill many a page"] * 8), "h") for i in range(30)]  # hardly anything else
    copy = "\n".join(line() for _ in range(6))
    texts += [(200 + i, copy, "h") for i in range(80)]
    found = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    assert all(found[i].kept and found[i].removed_words == 5 for i in range(60))
    assert all(found[200 + i].kept and found[200 + i].removed_words == 0 for i in range(80))
    assert not any(found[100 + i].kept for i in range(30))


def test_languages(spark, docs, none):
    r = np.random.default_rng(6)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["the", "ing", "sch"], "zz": ["ción", "ñal", "os"]}
    text = lambda k: " ".join("".join(r.choice(parts[k], 3)) for _ in range(60))
    own = [(i, text(k := list(parts)[i % 3]), k) for i in range(90)]
    df = spark.createDataFrame([*own, (900, None, "xx"), (901, "12 !!", None), (902, "", "yy")], "doc_id long, text string, lang string")
    profiles = language.learn_profiles(df.where("doc_id < 45"))
    found = {x.doc_id: x for x in language.identify_languages(df, profiles).collect()}
    assert all(found[i].lang_pred == k for i, _, k in own) and all(0 <= x.score <= 1 for x in found.values())
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert language.identify_languages(none, profiles).collect() == []
    assert {x.lang_pred for x in language.identify_languages(df, {}).collect()} == {"und"}


def test_forest_learns_and_flattens():
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = quality_model.fit(x[:2000], y[:2000], trees=40)
    assert ((quality_model.probability(forest, x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    feature, threshold, left, right, value, roots, start, _ = forest

    def walk(root, row):
        while left[root] != root:
            root = left[root] if row[feature[root]] <= threshold[root] else right[root]
        return value[root]

    for row, m in zip(x[:20], quality_model.margin(forest, x[:20]), strict=True):
        assert math.isclose(m, start + sum(walk(k, row) for k in roots), rel_tol=1e-9)


def test_quality_model(spark, docs, none):
    r = np.random.default_rng(9)
    good = lambda: " ".join(f"word{k}" for k in r.integers(0, 500, 80))
    bad = lambda: " ".join(f"W{k}###" for k in r.integers(0, 500, 80))
    own = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in own] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in own] + [(5, None), (None, 1), (12345, 1)], "doc_id long, quality int")
    forest = quality_model.train(df, labels.where("doc_id < 150 or doc_id is null"))
    found = {x.doc_id: x.score for x in quality_model.quality_scores(df, forest).collect()}
    assert np.mean([(found[i] >= 0.5) == q for i, _, q in own]) > 0.98 and 0 <= found[999] <= 1
    assert quality_model.quality_scores(none, forest).collect() == []
    assert 0 <= quality_model.quality_scores(df, quality_model.train(df, labels.where("false"))).first().score <= 1


def spots(text):
    words = re.split(spotsigs.BREAK.replace(r"\[", r"\["), (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in spotsigs.NO_CONTENT][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out or {tuple(words)}


def test_spotsigs(docs, rows, none):
    found = {r.doc_id: r for r in spotsigs.spotsigs(docs).collect()}
    texts = {d: t or "" for d, t, *_ in rows}
    for d, t in texts.items():
        assert len(found[d].signatures) == len(spots(t)) and found[d].n_chars == len(t) and found[d].fingerprint == "".join(f"{x & 0xFFFFFFFF:08x}" for x in found[d].signatures)
    by_text = collections.defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(found[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert spotsigs.spotsigs(none).collect() == []
    all_docs = spotsigs.spotsigs(docs.dropDuplicates(["doc_id"])).cache()
    got = {(r.query_id, r.doc_id) for r in spotsigs.similar_fingerprints(all_docs.where("doc_id % 2 = 0"), all_docs).collect()}
    sets = {d: spots(t) for d, t in texts.items()}
    assert got == {(a, b) for a in sets for b in sets if a % 2 == 0 and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]) - 1e-9}


def test_spotsigs_query(spark, tmp_path, rows):
    unique = list({d: (d, t) for d, t, *_ in rows}.values())
    spark.createDataFrame(unique, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    ordered = sorted(((d, t or "") for d, t in unique), reverse=True)
    found = {r.doc_id: r for r in spotsigs.op8_spotsigs(spark, str(tmp_path)).collect()}
    assert len(found) == len(unique)
    for k, (d, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        a, b, c = spots(t), spots(edited), spots(following)
        assert found[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(found[d].near_edited, len(a & b) / len(a | b), abs_tol=1e-9) and math.isclose(found[d].near_next, len(a & c) / len(a | c), abs_tol=1e-9)


def brute_licenses(text):
    text = text or ""
    units = text.lower().split("\n") + ([text.lower()] if "\n" in text else [])
    hits, names, best = 0, set(), (0.0, None)
    for u in units:
        own = set(licenses.bigrams_of(re.sub("[^a-z0-9]+", " ", u).split()))
        found = []
        for name, t in licenses.TEMPLATES:
            theirs = set(licenses.bigrams_of(licenses.template_words(t)))
            low, high = licenses.size_bounds(len(theirs), licenses.DICE)
            d = 2 * len(own & theirs) / (len(own) + len(theirs))
            if own and low <= len(own) <= high and d >= licenses.DICE:
                found.append((d, name))
        hits += bool(found)
        names |= {n for _, n in found}
        for d, n in found:
            if d > best[0] or d == best[0] and n < best[1]:
                best = d, n
    return hits, ",".join(sorted(names)), best[1]


def test_licenses(spark, docs, rows, none):
    texts = [x for _, x in licenses.TEMPLATES] + ["x\nReleased under the  MIT license!\ny", "All rights reserved", "This work is licensed under the GNU General Public License, version 7.", "licensed under mit", "rights", None, "\n\n", "Licensed under the Apache License,\nVersion 2.0."]
    own = [(i, t) for i, t in enumerate(texts)] + [(1000 + d, t) for d, t, *_ in rows]
    found = licenses.scan_licenses(spark.createDataFrame(own, "doc_id long, text string")).collect()
    want = collections.Counter((d, *brute_licenses(t)) for d, t in own)
    assert collections.Counter((r.doc_id, r.n_units, r.licenses, r.best_license) for r in found) == want
    assert licenses.scan_licenses(none).collect() == []
    for op in (licenses.scan_licenses, spotsigs.spotsigs):
        assert "Python" not in op(docs)._jdf.queryExecution().executedPlan().toString()
