"""BPE encoding and decoding of whole texts with an index of pair occurrences.

All new words of a batch are laid out as one sequence of symbols with links to neighbours. Each adjacent pair that has
a merge rank is indexed: rank -> all positions where the pair stands. The active ranks are applied in ascending order;
applying one merges all its positions at once (leftmost first where equal symbols overlap), and the pairs that the
merged symbols form with their neighbours are added to the lists of their ranks. Positions whose symbols have changed
meanwhile are stale and dropped when their rank is applied.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .pretokens import WordCache, default_path, latin_pattern, plain, slices


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it prints, else the
    next letter from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encodes as the tokenizers library does with a byte-level BPE file that has an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.added = {x["content"]: x["id"] for x in config["added_tokens"]}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.token = {v: k for k, v in vocab.items()} | {v: k for k, v in self.added.items()}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        pairs = np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64)
        self.left, self.right = pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        self.rank_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_order]
        # The letters of a piece, as bytes of the text.
        self.to_byte = {c: b for b, c in enumerate(letters)}
        self.pieces = latin_pattern()
        self.cache = WordCache(self._words)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 where there is none."""
        wanted = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_order[at], -1)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each piece, given as its bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(data), np.cumsum(lengths) - 1
        ends = ends[lengths > 0]
        symbol = self.inner[data]
        symbol[ends] = self.last[data[ends]]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends] = -1
        before[np.concatenate(([0], ends[:-1] + 1))[: len(ends)]] = -1
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Puts the pairs that start at these positions into the lists of their ranks."""
            ranks = self._ranks(symbol[at], symbol[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for k, own in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if k not in index:
                    heapq.heappush(active, k)
                index[k].append(own)

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            at = at[symbol[at] == a]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # runs of one symbol: leftmost pairs first
                at = np.sort(at)
                keep, taken = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[rank]
            symbol[gone] = -1
            following = after[gone]
            after[at] = following
            has = following >= 0
            before[following[has]] = at[has]
            previous = before[at]
            note(np.unique(np.concatenate((previous[previous >= 0].astype(np.int64), at[has].astype(np.int64)))))
        kept = symbol >= 0
        counts = np.concatenate(([0], np.cumsum(kept)))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        ids = symbol[kept].tolist()
        cuts = counts[bounds].tolist()
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded tokens) of plain lower-case words."""
        split = [self.pieces.findall(w) for w in words]
        known: dict[str, int] = {}
        for pieces in split:
            for piece in pieces:
                known.setdefault(piece, len(known))
        merged = self.merge([p.encode() for p in known])
        done = [(array("I", x).tobytes(), " ".join([self.token[i] for i in x]).encode()) for x in merged]
        out = []
        for pieces in split:
            if len(pieces) == 1:
                out.append(done[known[pieces[0]]])
            else:
                own = [done[known[p]] for p in pieces]
                out.append((b"".join([x for x, _ in own]), b" ".join([x for _, x in own])))
        return out

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        """A text that is not plain: added tokens are cut out, the rest is normalised and split by the library."""
        ids: list[int] = []
        end = 0
        for found in [*self.added_pattern.finditer(text), None]:
            part = text[end : found.start() if found else len(text)]
            if part:
                pieces = [x for x, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]
                for own in self.merge([bytes(map(self.to_byte.__getitem__, x)) for x in pieces]) if pieces else ():
                    ids += own
            if found:
                ids.append(self.added[found[0]])
                end = found.end()
        return array("I", ids).tobytes(), self.decode(ids).encode()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded ids in UTF-8."""
        split = [x.lower().split() if plain(x) else None for x in texts]
        self.cache.add([x for x in split if x])
        known, out = self.cache.known, []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self._whole(text))
            else:
                own = [known[w] for w in words]
                out.append((b"".join([x for x, _ in own]), b" ".join([x for _, x in own])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by spaces, added tokens as they are."""
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(1)
def pair_encoder(path: str) -> PairIndexEncoder:
    """The worker's encoder; its words stay known from task to task."""
    return PairIndexEncoder(path)


def encoded(path: str):
    """mapInArrow: (doc_id, n_tokens, ids, decoded) of whole texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(path)
        for batch in rows:
            texts = batch.column("text").to_pylist()
            for start, end in slices(texts):
                found = encoder.encode(texts[start:end])
                ids = [x for x, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x for _, x in found], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def digests(path: str):
    """mapInArrow: like ``encoded``, with SHA-256 digests in place of ids and text, so they never leave the worker."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encoded(path)(rows):
            sha = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(c)], pa.string()) for c in ("ids", "decoded")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded binary) of every whole text; one row for each row, in no fixed order.

    A null text is an empty one: no tokens, an empty decoded text. Other columns are ignored; an empty table gives an
    empty result. ``path``: a byte-level BPE file with an end-of-word suffix and no decoder.
    """
    return documents(docs).mapInArrow(encoded(path or default_path()), "doc_id long, n_tokens long, ids binary, decoded binary")


def op3_bpe_encode(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.mapInArrow(digests(default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
