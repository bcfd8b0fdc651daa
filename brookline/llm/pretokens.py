"""Splitting texts for the word-level BPE vocabulary exactly as the tokenizers library does.

Pieces never span white space, and white space is dropped, so a text is encoded word by word and each distinct word
of a task only once. Texts of characters below U+0250, without the four separators U+001C-U+001F (which Python takes
for white space) and without ``<|`` (which may start an added token) take that path; NFC leaves them as they are. All
other texts go to the library whole.

``LibraryEncoder.flat`` does so with whole columns: pieces are cut by the kinds of neighbouring bytes, and Python sees
only the distinct pieces of a slice. There, texts with letters whose lower case is longer or beyond U+024F go to the
library too.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import string_bytes

#: Set before the library loads: its threads would contend with Spark's tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ODD = re.compile("[^\x00-\x1b\x20-ɏ]")
#: Distinct words, and characters of words, that a worker keeps, over all its tasks; beyond, it starts anew.
MOST_WORDS, MOST_CHARACTERS = 800_000, 16_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plain(text: str) -> bool:
    return "<|" not in text and not ODD.search(text)


class WordCache:
    """Word -> what ``encode_words`` makes of it, with a bound on its size."""

    def __init__(self, encode_words: Callable[[list[str]], list]):
        self.encode_words, self.known, self.characters = encode_words, {}, 0

    def add(self, texts: Iterable[list[str]]) -> None:
        """Learns all words of the texts."""
        if len(self.known) > MOST_WORDS or self.characters > MOST_CHARACTERS:
            self.known, self.characters = {}, 0
        new = list(set().union(*texts).difference(self.known))
        self.characters += sum(map(len, new))
        self.known.update(zip(new, self.encode_words(new), strict=True))


def latin_pattern() -> re.Pattern:
    """The vocabulary file's splitting pattern for characters below U+0250, where Python's own classes need no trust."""
    below = [chr(i) for i in range(0x250)] + ["\u0307"]  # the dot that lower-casing U+0130 leaves
    kind = {c: unicodedata.category(c)[0] for c in below}
    spaces = [*map(chr, range(0x09, 0x0E)), " ", "\x85", "\xa0"]
    some = lambda cs: "".join(map(re.escape, cs))
    letters, numbers = some([c for c in below if kind[c] == "L"]), some([c for c in below if kind[c] == "N"])
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{some(spaces)}{letters}{numbers}]+")


#: Kinds of the characters below U+0250: white space, letters, numbers, others.
KIND = np.array([0 if chr(i).isspace() else {"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 3) for i in range(0x250)], np.uint8)
#: RE2 pattern of what sends a text of a column to the library whole.
HARD = "<\\||[\\x1c-\\x1f%s\\x{250}-\\x{10ffff}]" % "".join(f"\\x{{{i:x}}}" for i in range(0x250) if len(chr(i).lower()) > 1 or chr(i).lower() >= "\u0250")


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case pieces, as ``latin_pattern`` finds them, of texts without HARD, and the n + 1 piece offsets of the texts."""
    # The space keeps the last piece of a text apart from the next text.
    data, offsets = string_bytes(pc.binary_join_element_wise(pc.utf8_lower(texts.cast(pa.large_string())), *pa.array(["", " "], pa.large_string())))
    kind = KIND[data]
    lead = np.flatnonzero(data >= 0x80)[::2]  # all others take two bytes
    kind[lead] = kind[lead + 1] = KIND[(data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63]
    begins = kind == 2  # a number is a piece of its own
    begins[:1] = True
    begins[1:] |= kind[1:] != kind[:-1]
    begins[lead + 1] = False
    # Endings: an apostrophe that starts a run of others takes the letters of an ending, and the rest is another piece.
    quote = np.flatnonzero(begins & (data == ord("'")))
    a, b = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    one = quote[np.isin(a, np.frombuffer(b"stmd", np.uint8))]
    two = quote[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
    begins[one + 1] = begins[two + 1] = False
    begins[one + 2] = begins[two + 3] = True
    starts = np.flatnonzero(begins)
    own = kind[starts] > 0
    ends = np.cumsum(np.diff(starts, append=len(data))[own])
    bounds = np.concatenate(([0], ends))
    pieces = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(bounds), pa.py_buffer(data[kind > 0]))
    return pieces, np.searchsorted(starts[own], offsets)


class LibraryEncoder:
    """Ids of texts as little-endian unsigned 16-bit integers (the vocabulary has 49,408 ids).

    New words are cut into pieces, and new pieces go to the library's model many to a call, past the normaliser and the
    splitting pattern, whose work on plain lower-case words is done. The last id of each piece is one of those that end
    a word, which tells the pieces' ids apart again.
    """

    PIECES = 400

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for x in (self.library, self.model):
            x.no_truncation()
            x.no_padding()
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.library.get_vocab_size()
        if size > 65536:
            raise ValueError("ids must fit 16 bits")
        suffix = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.pattern = latin_pattern()
        self.pieces = WordCache(self._pieces)
        self.cache = WordCache(self._words)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(pieces), 64 * self.PIECES):
            part = pieces[at : at + 64 * self.PIECES]
            texts = [" ".join(part[k : k + self.PIECES]) for k in range(0, len(part), self.PIECES)]
            ids = np.concatenate([np.array(x.ids, np.uint16) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)])
            cuts = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        split = [(w,) if w.isalpha() else self.pattern.findall(w) for w in words]
        self.pieces.add(split)
        known = self.pieces.known
        return [known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x]) for x in split]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [x.lower().split() if plain(x) else None for x in texts]
        self.cache.add([x for x in split if x])
        known = self.cache.known.__getitem__
        return [np.array(self.library.encode(x, add_special_tokens=False).ids, np.uint16).tobytes() if words is None else b"".join(map(known, words)) for x, words in zip(texts, split, strict=True)]

    def flat(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts without nulls, one after another, ``end`` after each text, and their numbers."""
        hard = pc.match_substring_regex(texts, HARD)
        pieces, rows = cut(pc.if_else(hard, pa.scalar("", texts.type), texts))
        pieces = pieces.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split()
        self.pieces.add([distinct])
        own = list(map(self.pieces.known.__getitem__, distinct))
        # What follows the pieces of a text: its end, or all of a text that went to the library.
        last = np.full(len(texts), len(own), np.int32)
        whole = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        last[whole] += np.arange(1, len(whole) + 1, dtype=np.int32)
        own += [end, *(np.array(self.library.encode(x, add_special_tokens=False).ids, np.uint16).tobytes() + end for x in texts.take(pa.array(whole)).to_pylist())]
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 2
        ids, first = np.frombuffer(b"".join(own), np.uint16), np.cumsum(lengths) - lengths
        parts = np.insert(pieces.indices.to_numpy(), rows[1:], last)
        n = lengths[parts]
        ends = np.cumsum(n)
        at = np.repeat(first[parts] - (ends - n), n)
        at += np.arange(len(at))
        return ids[at], np.diff(ends[rows[1:] + np.arange(len(texts))], prepend=0)


@functools.lru_cache(1)
def library_encoder(path: str) -> LibraryEncoder:
    """The worker's encoder; its words stay known from task to task."""
    return LibraryEncoder(path)


def forget_words() -> None:
    """Drops the words that this worker has learned: for tasks of other operators that need its memory."""
    library_encoder.cache_clear()


def slices(texts: list[str], most: int = 4_000_000) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` characters, or of one longer row."""
    out, start, held = [], 0, 0
    for k, x in enumerate(texts):
        if held and held + len(x) > most:
            out.append((start, k))
            start, held = k, 0
        held += len(x)
    return [*out, (start, len(texts))] if texts else []
