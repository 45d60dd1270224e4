"""Byte-level BPE encoding and decoding by replaying merges over a whole batch of words.

Distinct words of a chunk form the corpus. An inverted index maps every merge rank (token pair) to the positions
where it applies; ranks are replayed in ascending order and each merge only touches its two neighbours. Merges
that open a lower rank than the one replayed put their word on a list that is encoded alone, lowest rank first.

Null texts count as empty; empty texts have no ids. Very long texts make a chunk of their own, and a very long word takes
n log n steps. Repeated rows and extra columns do not matter: one row goes out for each row that comes in, none for an
empty table. Words of one task are told apart by 64-bit keys.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from slotloom.llm.wordstream import Memo, Stream, chunks, ragged

NONE = np.int64(1 << 40)


class Ranks:
    """The rank file: token bytes and the table of pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for k, v in self.rank.items():
            token[v] = k
        self.blob = np.frombuffer(b"".join(token), np.uint8)
        self.length = np.fromiter(map(len, token), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pair = {}
        for text, rank in self.rank.items():
            for i in range(1, len(text)):
                a, b = self.rank.get(text[:i]), self.rank.get(text[i:])
                if a is not None and b is not None:
                    pair[a << 32 | b] = rank
        self.pair_key = np.array(sorted(pair), np.int64)
        self.pair_rank = np.array([pair[k] for k in self.pair_key.tolist()], np.int64)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def alone(self, word: bytes) -> list[int]:
        """One word, always merging the leftmost pair of the lowest rank: pairs wait in a heap, so a word of n bytes takes
        n log n steps."""
        n = len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.rank.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j < 0 or part[j] != y:
                continue
            part[i], part[j] = x + y, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.rank.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[after[k]]))
        return [self.rank[p] for p in part if p is not None]

    def replay(self, blob: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words laid end to end, ids per word). blob: the words' bytes; size: bytes per word (over 0)."""
        n = len(blob)
        word_at = np.cumsum(size) - size
        word = np.repeat(np.arange(len(size)), size)
        symbol = self.byte[blob]
        following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[np.cumsum(size) - 1] = -1
        preceding[word_at] = -1
        alive = np.ones(n, bool)
        pending = np.full(n, NONE)
        inner = np.flatnonzero(following >= 0)
        pending[inner] = self.merge_rank(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            at = at[pending[at] < NONE]
            if not len(at):
                return
            rank = pending[at]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            for r, lo, hi in zip(rank[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(at[lo:hi])

        post(inner)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            posted = index.pop(r)
            at = posted[0] if len(posted) == 1 else np.unique(np.concatenate(posted))
            at = at[alive[at] & (pending[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                chained = following[at[:-1]] == at[1:]
                if chained.any():  # runs such as aaa: every second one, from the left
                    run = np.concatenate([[True], ~chained])
                    begin = np.flatnonzero(run)
                    at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            gone = following[at]
            symbol[at] = r
            alive[gone] = False
            pending[gone] = NONE
            after = following[gone]
            following[at] = after
            more = after >= 0
            preceding[after[more]] = at[more]
            pending[at] = NONE
            right = at[more]
            pending[right] = self.merge_rank(symbol[right], symbol[after[more]])
            before = preceding[at]
            left = before[before >= 0]
            pending[left] = self.merge_rank(symbol[left], symbol[following[left]])
            touched = np.concatenate([right, left])
            if len(touched) > 1:
                touched.sort()
                touched = touched[np.concatenate([[True], touched[1:] != touched[:-1]])]
            lower = touched[pending[touched] < r]
            if len(lower):
                odd.append(word[lower])
            post(touched)
        kept = np.flatnonzero(alive)
        counts = np.bincount(word[kept], minlength=len(size))
        ids = symbol[kept]
        if odd:
            again = np.unique(np.concatenate(odd))
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for w in again.tolist():
                parts[w] = np.array(self.alone(blob[word_at[w] : word_at[w] + size[w]].tobytes()), np.int64)
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids."""
        return self.blob[ragged(self.offset[ids], self.length[ids])].tobytes()


@functools.lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    """Encodes chunks of texts; remembers words between chunks. ``new_words(blob, size)`` gives ids of unseen words; ids
    are below ``vocabulary``."""

    def __init__(self, new_words, vocabulary: int, most: int = 1 << 19):
        self.new_words = new_words
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.memo = Memo(most)
        self.clear()

    def clear(self) -> None:
        self.memo.clear()
        self.fresh: list[tuple] = []
        self.ids = np.zeros(1 << 16, self.kind)
        self.used = 0
        self.offset = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)

    def _grow(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(max(size, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _look(self, texts: list[str | None]) -> tuple:
        """(distinct keys, key number of every piece, piece offsets of the texts); unseen words join the new ones."""
        stream = Stream(texts)
        begin, end = stream.pieces()
        key, first, inverse = np.unique(stream.keys(begin, end), return_index=True, return_inverse=True)
        new = self.memo.find(key)[1]
        if new.any():
            at = first[new]
            b, e = stream.byte_at[begin[at]], stream.byte_at[end[at]]
            self.fresh.append((key[new], stream.bytes[ragged(b, e - b)], e - b))
        return key, inverse.astype(np.int32), stream.per_text(begin)

    def _learn(self) -> None:
        """Encode the words that no chunk so far has held."""
        if not self.fresh:
            return
        keys, blobs, sizes = (np.concatenate(x) for x in zip(*self.fresh))
        self.fresh = []
        key, first = np.unique(keys, return_index=True)
        at = (np.cumsum(sizes) - sizes)[first]
        size = sizes[first]
        ids, counts = self.new_words(blobs[ragged(at, size)], size)
        rows = self.memo.add(key)
        self._grow("ids", self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self._grow("offset", self.memo.size)
        self._grow("count", self.memo.size)
        self.offset[rows] = self.used + np.cumsum(counts) - counts
        self.count[rows] = counts
        self.used += len(ids)

    def __call__(self, texts: list[str | None], together: int = 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For one range of texts after the other: its bounds, the ids of its texts laid end to end, their offsets."""
        spans = list(chunks(texts))
        for k in range(0, len(spans), together):
            if self.memo.size > self.memo.most:
                self.clear()
            looks = [(lo, hi, *self._look(texts[lo:hi])) for lo, hi in spans[k : k + together]]
            self._learn()
            for lo, hi, key, inverse, piece_at in looks:
                row = self.memo.find(key)[0]
                counts = self.count[row].astype(np.int64)[inverse]
                ids = self.ids[ragged(self.offset[row][inverse], counts)]
                yield lo, hi, ids, np.concatenate([[0], np.cumsum(counts)])[piece_at]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(ranks(path).replay, len(ranks(path).length))


#: Bytes of text that are Python strings at once.
SLICE = 1 << 21


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts (second column) of each begin within the same SLICE bytes."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
        place = (np.cumsum(size) - size) // SLICE
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(lo, hi - lo)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of every
    text; with_ids adds the ids themselves. vocabulary: path of a rank file on every machine."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(vocabulary), ranks(vocabulary)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for lo, hi, ids, at in encode(texts):
                own = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                    pa.array([hashlib.sha256(table.decode(x)).hexdigest() for x in own]),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
