"""Vectorised word streams: a batch of texts becomes arrays of word spans and 64-bit word keys.

All work is numpy over the UTF-8 bytes and code points of a bounded chunk of texts, so a task's memory
depends on the chunk (or on one text, if that is longer), never on the partition.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import xxhash

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CHUNK = 1 << 18
#: Words longer than this are hashed as a whole; shorter ones by the rolling sum.
LONG_WORD = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _give_back() -> None:
    """Large arrays get pages of their own, which return to the system when they are freed; otherwise a worker that is
    used again keeps the most that any of its steps has needed. Where the C library has no such setting, nothing changes."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)
    except (OSError, AttributeError):
        pass


_give_back()


@functools.cache
def class_table() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    spaces = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[sorted(spaces)] = SPACE
    return table


@functools.cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_MUL), -1, 1 << 64))
    up, down = np.full(size, _MUL, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, n of each at least."""
    size = 1 << max(20, int(n - 1).bit_length())
    return _powers(size)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; one longer text makes a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Stream:
    """Texts of one chunk laid end to end."""

    def __init__(self, texts: list[str | None]):
        joined = "".join(t or "" for t in texts)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.bytes = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lengths)])
        if len(self.bytes) == len(self.codes):
            self.byte_at = np.arange(len(self.codes) + 1)
        else:
            c = self.codes
            self.byte_at = np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000).astype(np.int64))])
        self.cls = class_table()[self.codes]

    def _breaks(self) -> np.ndarray:
        """True at the first character of every non-empty text."""
        first = np.zeros(len(self.codes) + 1, bool)
        first[self.text_at] = True
        return first[:-1]

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans (in characters) of maximal runs of members inside one text."""
        if not len(member):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = self._breaks()
        before = np.concatenate([[False], member[:-1]])
        after = np.concatenate([member[1:], [False]])
        next_first = np.concatenate([first[1:], [True]])
        return np.flatnonzero(member & (~before | first)), np.flatnonzero(member & (~after | next_first)) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of runs of letters and numbers."""
        return self.runs(self.cls <= NUMBER)

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the pieces that byte-level BPE encodes one by one: contractions, an optional space before a
        run of letters, numbers or other signs, and white space, whose last space goes to the next piece."""
        n = len(self.codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cls, codes, first = self.cls, self.codes, self._breaks()
        run = first.copy()
        run[1:] |= cls[1:] != cls[:-1]
        start = run.copy()
        at = np.flatnonzero(run)
        end = np.concatenate([at[1:], [n]])
        text_ends = np.concatenate([first, [True]])
        inner = (cls[at] == SPACE) & ~text_ends[end]
        last = end[inner] - 1
        start[last] = True
        start[end[inner][codes[last] == 32]] = False
        # A lone apostrophe that no space has claimed, and letters after it.
        mark = np.flatnonzero((codes == 39) & start)
        if len(mark):
            tail = np.concatenate([codes, [0, 0, 0]])
            open_ = np.concatenate([text_ends, [True, True, True]])
            a, b = tail[mark + 1], tail[mark + 2]
            one = np.isin(a, [ord(x) for x in "stmd"]) & ~open_[mark + 1]
            pair = [(ord(x[0]), ord(x[1])) for x in ("re", "ve", "ll")]
            two = np.zeros(len(mark), bool)
            for x, y in pair:
                two |= (a == x) & (b == y)
            two &= ~open_[mark + 1] & ~open_[mark + 2]
            start[mark[one | two] + 1] = False
            for hit, k in ((one, 2), (two, 3)):
                where = mark[hit] + k
                start[where[where < n]] = True
        begin = np.flatnonzero(start)
        return begin, np.concatenate([begin[1:], [n]])

    def keys(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit key for the bytes of each span."""
        b, e = self.byte_at[begin], self.byte_at[end]
        up, down = powers(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_byte_values()[self.bytes] * up[: len(self.bytes)], out=sums[1:])
        size = (e - b).astype(np.uint64)
        key = (sums[e] - sums[b]) * down[b]
        key ^= key >> np.uint64(29)
        key = (key + size) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        for i in np.flatnonzero(size > LONG_WORD):
            key[i] = xxhash.xxh64_intdigest(self.bytes[b[i] : e[i]].tobytes(), seed=1)
        return key

    def text_of(self, begin: np.ndarray) -> np.ndarray:
        """Index of the text that holds each position."""
        return np.searchsorted(self.text_at, begin, side="right") - 1

    def per_text(self, begin: np.ndarray) -> np.ndarray:
        """Offsets of each text's spans in a sorted list of span starts."""
        return np.searchsorted(begin, self.text_at)


def ragged(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i] + counts[i] - 1, one after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(offsets - before, counts) + np.arange(total)


class Memo:
    """Rows computed once per distinct key; bounded, and emptied when full, so that results never depend on it."""

    def __init__(self, most: int = 1 << 21):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.size = 0

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each key or -1, mask of unknown keys)."""
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        return np.where(known, self.row[at] if len(self.row) else -1, -1), ~known

    def add(self, key: np.ndarray) -> np.ndarray:
        """Rows given to new distinct keys."""
        rows = np.arange(self.size, self.size + len(key))
        self.size += len(key)
        both, row = np.concatenate([self.key, key]), np.concatenate([self.row, rows])
        order = np.argsort(both, kind="stable")
        self.key, self.row = both[order], row[order]
        return rows
