"""Ids of whole columns against the tokenizers library, and how much of that work reaches Python."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brookline.llm import token_orc
from brookline.llm.pretokens import HARD, LibraryEncoder, default_path

ODD = ["", " ", "'", "'s", "a'", "it's we'll THEY'RE 'tis ''s 's's l'l", "\x85a\xa0b", "x²½3 45", "Əli, Ɓa. ƏƁ", "İs.", "Ⱥ.", "a\x1cb", "a <|endoftext|> b", "日本 é", "\x00."]


@pytest.fixture(scope="module")
def encoder():
    return LibraryEncoder(default_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def below() -> list[str]:
    return [chr(i) for i in range(0x250)]


@pytest.mark.parametrize("letters", ["''''''stmdrevlSTRE  7²é\n.\"x", "".join(below()), "".join(ODD)])
def test_flat_ids_are_the_librarys(encoder, library, letters):
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list(letters), r.integers(0, 20))) for _ in range(3000)] + ODD
    ids, n = encoder.flat(pa.array(texts), b"\1\0")
    want = [[*library.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert n.tolist() == list(map(len, want))
    assert ids.tolist() == sum(want, [])


def test_lower_case_and_white_space_are_pythons():
    import pyarrow.compute as pc

    plain = [c for c in below() if not pc.match_substring_regex(pa.array([c]), HARD)[0].as_py()]
    assert len(plain) > 500
    assert pc.utf8_lower(pa.array(plain)).to_pylist() == [c.lower() for c in plain]


def test_a_column_of_no_rows_or_no_words(encoder):
    for texts, end, want in (([], b"\1\0", []), ([""], b"", [0]), (["", " \n"], b"\1\0", [1, 1])):
        ids, n = encoder.flat(pa.array(texts, pa.string()), end)
        assert n.tolist() == want and ids.tolist() == [1] * sum(want)


def test_slices_of_a_column(encoder, library):
    texts = pa.array(["one two", "three's", "Əli,", "four"])
    ids, n = encoder.flat(texts.slice(1, 2))
    want = [library.encode(x, add_special_tokens=False).ids for x in ("three's", "Əli,")]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


def test_python_sees_each_distinct_piece_of_a_slice_once(monkeypatch):
    seen, encoder = [], LibraryEncoder(default_path())
    add = encoder.pieces.add
    monkeypatch.setattr(encoder.pieces, "add", lambda texts: add(seen.extend(texts) or texts))
    monkeypatch.setattr(encoder, "ids", None)  # word by word
    monkeypatch.setattr(token_orc, "library_encoder", lambda path: encoder)
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, and more words. " * 5000, "words"]})
    made = list(token_orc.token_rows(default_path(), 1)(iter([rows])))
    assert [sorted(x) for x in seen] == [[",", ".", "and", "more", "some", "words"]]
    assert [x for b in made for x in b.column("n_tokens").to_pylist()] == [35001, 2]


def test_op4_of_odd_texts(spark, tmp_path, library):
    rows = [(k, x) for k, x in enumerate(ODD)] + [(len(ODD), None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    start, want = 0, []
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_orc.op4_token_orc(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
