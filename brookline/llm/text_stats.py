"""Statistics of whole texts, computed for many rows at once on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import POSITION, RADIX, RADIX_INVERSE, SPACE, _power, mix, pieces, string_bytes, word_hashes, word_spans


def _flags(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


LETTER_START = np.array([b & 0xC0 != 0x80 for b in range(256)])  # a code point's first byte
SYMBOL = _flags(b"#*$%&|<>")
UPPER, DIGIT = _flags(bytes(range(65, 91))), _flags(b"0123456789")
STOP, BANG, BAR, PUNCTUATION = _flags(b".?;:"), _flags(b"!"), _flags(b"|"), _flags(b",.;:!?'\"()-")
WIDE = np.array([b >= 0xC0 for b in range(256)])


class Slice:
    """Some rows of a string column: bytes, words and lines with the offsets of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.words = word_spans(data, offsets)
        self.n_words = np.diff(self.words)

    def per_row(self, flags: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """How many flags are set in each row."""
        offsets = self.offsets if offsets is None else offsets
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def letters(self, flags: np.ndarray) -> np.ndarray:
        return self.per_row(flags[self.data])

    def word_chars(self) -> np.ndarray:
        return self.per_row(LETTER_START[self.data] & ~SPACE[self.data])

    def repeated_words(self, n: int = 3) -> np.ndarray:
        """Words in windows of n words that are found twice or more in the text."""
        hashes = word_hashes(self.data, self.starts, self.ends, lower=False)
        covered = np.zeros(len(hashes), bool)
        if len(hashes) >= n:
            width = len(hashes) - n + 1
            row = np.repeat(np.arange(self.rows), self.n_words)
            inside = row[:width] == row[n - 1 :]
            rolled = row[:width].astype(np.uint64) * POSITION[50]
            for j in range(n):
                rolled += hashes[j : j + width] * POSITION[j]
            at = np.flatnonzero(inside)
            order = at[np.argsort(rolled[at], kind="stable")]
            same = rolled[order[1:]] == rolled[order[:-1]]
            twice = np.zeros(len(order), bool)
            twice[1:] |= same
            twice[:-1] |= same
            for j in range(n):
                covered[order[twice] + j] = True
        return self.per_row(covered, self.words)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines with a word: (row, hash as it stands, hash normalised, words, position among the row's lines).

        Normalised: A-Z lower-cased, white space around dropped and within taken as one space.
        """
        breaks = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate((self.offsets[:-1][np.diff(self.offsets) > 0], breaks + 1)))
        starts = starts[starts < len(self.data)]
        row = np.searchsorted(self.offsets, starts, "right") - 1
        ends = np.minimum(np.concatenate((starts[1:], [len(self.data)])), self.offsets[row + 1])
        ends -= (self.data[np.maximum(ends - 1, 0)] == 10) & (ends > starts)
        first, last = np.searchsorted(self.starts, starts), np.searchsorted(self.starts, ends)
        own = last > first
        starts, ends, row, first, last = starts[own], ends[own], row[own], first[own], last[own]
        exact = word_hashes(self.data, starts, ends, lower=False) if len(starts) else np.zeros(0, np.uint64)
        hashes = word_hashes(self.data, self.starts, self.ends)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _power(RADIX, len(hashes)), out=sums[1:])
        normal = mix((sums[last] - sums[first]) * _power(RADIX_INVERSE, len(hashes) + 1)[first])
        return row, exact, normal, last - first, np.arange(len(row))

    def earlier_lines(self, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A flag for each line: an equal one stands earlier in its row."""
        order = np.lexsort((np.arange(len(row)), hashes, row))
        out = np.zeros(len(row), bool)
        same = (row[order[1:]] == row[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
        out[order[1:]] = same
        return out


def slices_of(column: pa.Array) -> Iterator[tuple[int, int, Slice]]:
    """(first row, last row + 1, slice) of small slices of a string column.

    Work memory is about 100 bytes a byte of a slice; a text longer than a slice is one slice.
    """
    data, offsets = string_bytes(column)
    for start, end in pieces(offsets, 1_000_000):
        yield start, end, Slice(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])


def per(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole, 0 where there is no whole."""
    return part / np.maximum(whole, 1)


#: The features of a document, in the order of ``features``.
FEATURES = ("words", "word_length", "symbols", "upper", "digits", "bars", "bangs", "stops", "punctuation", "wide", "repeated", "repeated_lines", "words_per_line", "lines", "distinct_words", "long_words", "short_words", "longest_word", "longest_line", "spaces")


def features(s: Slice) -> np.ndarray:
    """A row of float64 features for each text, of its whole length; zeros for an empty one."""
    letters, words = s.word_chars(), s.n_words
    row, exact, _, size, _ = s.lines()
    lines = np.bincount(row, minlength=s.rows)
    twice = np.bincount(row, weights=s.earlier_lines(row, exact), minlength=s.rows) if len(row) else np.zeros(s.rows)
    longest_line = np.zeros(s.rows)
    np.maximum.at(longest_line, row, size)
    length = s.ends - s.starts
    word_row = np.repeat(np.arange(s.rows), words)
    longest = np.zeros(s.rows)
    np.maximum.at(longest, word_row, length)
    hashes = word_hashes(s.data, s.starts, s.ends)
    order = np.lexsort((hashes, word_row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (word_row[order[1:]] != word_row[order[:-1]])
    distinct = np.bincount(word_row[order[new]], minlength=s.rows)
    return np.column_stack([
        np.log1p(words), per(letters, words), per(s.letters(SYMBOL), letters), per(s.letters(UPPER), letters), per(s.letters(DIGIT), letters), per(s.letters(BAR), words),
        per(s.letters(BANG), words), per(s.letters(STOP), words), per(s.letters(PUNCTUATION), letters), per(s.letters(WIDE), letters), per(s.repeated_words(), words), per(twice, lines), per(words, lines), np.log1p(lines),
        per(distinct, words), per(s.per_row(length > 12, s.words), words), per(s.per_row(length <= 3, s.words), words), np.log1p(longest), np.log1p(longest_line), per(s.letters(SPACE), letters),
    ])
