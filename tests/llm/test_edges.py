"""Cases that earlier versions got wrong: large and null ids, numbers that are no letters, small sets, files that split."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from brookline.llm import language, ngram_join, packing, token_orc
from brookline.llm.common import hashed_words, shingles
from brookline.llm.pretokens import default_path


def test_packing_keeps_large_and_null_ids(spark):
    rows = [(2**53 + 1, "a"), (2**53 + 3, "b c"), (None, "d"), (None, None), (2**53 + 1, "a")]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), window=4).collect()
    assert collections.Counter(r.doc_id for r in found) == {2**53 + 1: 2, 2**53 + 3: 1, None: 2}


def test_packing_deals_equal_rows(spark):
    found = packing.pack_documents(spark.createDataFrame([(1, "a")] * 300, "doc_id long, text string"), window=8, group=30).collect()
    assert len({r.sequence_id % 10 for r in found}) == 10 and len(found) == 300


def test_numbers_are_no_letters(spark):
    df = spark.createDataFrame([(1, "½"), (2, "²③ Ⅷ"), (3, "x½y")], "doc_id long, text string")
    profiles = {"xx": language.ranked(language.gram_ids("x y"), 9).tolist()}
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_languages(df, profiles).collect()}
    assert found[1] == ("und", 0.0) and found[2] == ("und", 0.0) and found[3] == ("xx", 1.0)


def test_distances_are_out_of_place():
    texts = {"xx": "an ant ran", "yy": "bob bobs ab"}
    profiles = {k: language.ranked(language.gram_ids(t), 6).tolist() for k, t in texts.items()}
    r = np.random.default_rng(1)
    for _ in range(50):
        text = "".join(r.choice(list("abnot r"), 20))
        own = collections.Counter(language.gram_ids(text).tolist())
        order = sorted(own, key=lambda g: (-own[g], g))[:6]
        want = {k: sum(abs(p.index(g) - i) if g in p else 6 for i, g in enumerate(order)) for k, p in profiles.items()}
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
        got = next(language.predictions(profiles, 6)(iter([batch]))).to_pylist()[0]
        if order:
            best = min(want, key=lambda k: (want[k], k))
            assert (got["lang_pred"], got["score"]) == (best, pytest.approx(1 - want[best] / (6 * len(order))))


def test_small_sets_link_at_fifty(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "q"), (4, "q"), (5, "a b c d e f g h")]
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=50).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}


def test_rows_without_ids_link(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[a : a + 40]) for a in (0, 4, 8, 12)]  # a chain: each links with the next only
    rows = [(9, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3])]
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.component_id for r in found] == [5] * 4


def test_a_long_chain_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 2000)
    monkeypatch.setattr(ngram_join, "RARE", 4)
    monkeypatch.setattr(ngram_join, "SHORT", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    rows = [(1000 - k, " ".join(words[3 * k : 3 * k + 40])) for k in range(80)]
    base = [f"b{k}" for k in range(60)]
    for k in range(120):
        own = list(base)
        for at in r.choice(60, int(r.integers(1, 4)), replace=False):
            own[at] = f"x{k % 40}"
        rows.append((2000 + k, " ".join(own)))
    found = {x.doc_id: x.component_id for x in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: frozenset(zip(*(t.split()[i:] for i in range(5)), strict=False)) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert found == {d: find(d) for d in sets}


def test_long_texts_hash_as_short_ones():
    import pyarrow as pa

    r = np.random.default_rng(2)
    texts = [" ".join("".join(r.choice(list("aBé"), r.integers(1, 9))) for _ in range(400)), "x" * 900, "", "a  b"]
    whole = [x for *_, w, o in hashed_words(pa.array(texts), 10**6) for x in shingles(w, o, 5)]
    parts = [x for *_, w, o in hashed_words(pa.array(texts), 100) for x in shingles(w, o, 5)]
    assert all(map(np.array_equal, whole, parts)) and len(whole) == len(parts) == 4


def test_orc_starts_when_files_would_split(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(int(d), f"some text of {d}") for d in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        found = sorted(token_orc.op4_token_orc(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    library, start, want = Tokenizer.from_file(default_path()), 0, []
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in found] == want


def test_orc_files_hold_indexes_and_prune(spark, tmp_path):
    from pyarrow import orc

    rows = [(2 * d, "x") for d in range(6000)]
    path = token_orc.write_token_orc(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/ids", files=1)
    file = next(tmp_path.joinpath("ids").glob("*.orc"))
    reader = orc.ORCFile(file)
    assert reader.row_index_stride == 1000 and reader.nrows == 6000
    options = spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    stripes = spark._jvm.org.apache.orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"file://{file}"), options).getStripes()
    assert all(stripes.get(k).getIndexLength() > 0 for k in range(stripes.size()))
    # A lookup reads the row group that may hold the id; the Bloom filter leaves none for an absent id between the bounds.
    read = []
    for doc_id, there in ((4000, 1), (4001, 0)):
        df = token_orc.find_tokens(spark, path, doc_id)
        assert len(df.collect()) == there
        read.append(df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value())
    assert read[0] <= 1000 and read[1] == 0


@pytest.mark.parametrize("rows", [[], [(None, "x y")], [(None, "the a b c d"), (None, None), (None, "the a b c d")], [(5, "abc the d e f"), (5, "abd the q r s"), (9, None), (None, "tail")], [(1, "")] * 3])
def test_spotsigs_query_of_odd_tables(spark, tmp_path, rows):
    import hashlib

    from brookline.llm import spotsigs

    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in spotsigs.op8_spotsigs(spark, str(tmp_path)).collect())
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = collections.Counter()
    for k, (d, t) in enumerate(ordered):
        third, following = len(t) // 3, ordered[(k + 1) % len(ordered)][1]
        want[d, len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()] += 1
    assert found == want


def test_row_groups_of_packed_tokens_are_bounded(spark, monkeypatch):
    """A task that wrote or read large rows held the whole file, beyond the executor's memory."""
    monkeypatch.setattr(ngram_join, "CHUNK", 2000)
    monkeypatch.setattr(ngram_join, "PART", 1000)
    monkeypatch.setattr(ngram_join, "BATCH", 8000, raising=False)
    monkeypatch.setattr(ngram_join, "GROUP", 8000, raising=False)
    tables, table = {}, ngram_join.Scratch.table
    monkeypatch.setattr(ngram_join.Scratch, "drop", lambda *_: None)
    monkeypatch.setattr(ngram_join.Scratch, "table", lambda self, df, name: tables.setdefault(name, table(self, df, name)))
    r = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in r.integers(0, 500, 400)) for _ in range(30)]
    rows = [(100 + k, x) for k, x in enumerate(base)] + [(k, f"{x} more words") for k, x in enumerate(base)] + [(200, ""), (201, None)]
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {x.doc_id: x.component_id for x in found.collect()} == {d: d if d >= 200 else d % 100 for d, _ in rows}
    files = [pq.ParquetFile(x.removeprefix("file://")).metadata for x in tables["first"].inputFiles()]
    assert max(x.row_group(k).total_byte_size for x in files for k in range(x.num_row_groups)) < 40_000


@pytest.mark.parametrize("row", [100, 10**9])
def test_cut_rows_of_packed_tokens_say_the_same(row, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROW", row)
    monkeypatch.setattr(ngram_join, "DOCUMENTS", row // 50)
    monkeypatch.setattr(ngram_join, "BATCH", 8000)
    r = np.random.default_rng(5)
    common = r.integers(0, 2**64, 2000, dtype=np.uint64)
    sets = [np.unique(np.concatenate((r.choice(common, 600), r.integers(0, 2**64, k, dtype=np.uint64)))) for k in range(10)]
    batches = []
    for chunk, own in enumerate((sets[:4], sets[4:])):
        ids = [10 * chunk + k for k in range(len(own))]
        batches += ngram_join.packed(ngram_join.chunk_of(chunk, 3, ids, [len(x) for x in own], ids, list(own), ids))
    if row == 100:
        assert max(x.nbytes for x in batches) < 16_000
        assert max(len(x or b"") for b in batches for x in b.column("tokens").to_pylist()) == 800
        assert max(len(x or []) for b in batches for x in b.column("ids").to_pylist()) == 2
    rows = pa.Table.from_batches(batches)
    rows = pa.concat_tables([ngram_join.add_up(rows.filter(pc.equal(rows.column("part"), p))) for p in sorted(set(rows.column("part").to_pylist()))])
    found = {}
    for chunk in range(2):
        for x in ngram_join.sets_of(50)(rows.filter(pc.equal(rows.column("chunk"), chunk))).to_pylist():
            found[x["node"]] = x["n"], x["lone"], sorted(np.frombuffer(x["tokens"], np.uint64).tolist())
    times = collections.Counter(t for x in sets for t in x.tolist())
    assert found == {k if k < 4 else k + 6: (len(x), sum(times[t] == 1 for t in x.tolist()), [t for t in x.tolist() if times[t] > 1]) for k, x in enumerate(sets)}
