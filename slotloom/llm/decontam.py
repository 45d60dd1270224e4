"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are runs of letters and numbers of the lower-cased text; a shingle is ``width`` words (an item of fewer words is
one shingle of all its words). The sketch of an item with n distinct shingles is its smallest hashes, so many that none
can be missed: containment of at least t leaves at most (1 - t) n shingles out, so one of the floor((1 - t) n) + 1
smallest hashes is in any document that holds so much of it. Items are partitioned by the power of two of n, and each
partition has the largest hash of its sketches as its limit. A document's signature is its hashes up to the limit of the
partitions whose items it is large enough for: with limits near the (1 - t) quantile that is about a quarter of them. A
fixed-size bit map of all sketches lets most of it fall before anything is shuffled; the hashes left are joined with the
sketches, and each (document, item) found so is verified: the share of the item's distinct shingles in the document, as
words. Documents without a hit never leave their task.

Distinct item texts are searched once and their items joined afterwards. Null, empty and wordless items and documents
take no part; null ids are kept; items that repeat an id each count, as do repeated rows of documents. Very long documents
are read whole. Empty tables give no rows; extra columns are left out of ``search`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.store import cut
from slotloom.llm.wordstream import Stream, chunks

WIDTH, LEAST = 5, 0.8
#: Bits of the map of sketch hashes; sketches up to this many rows are broadcast, more are joined by salted keys.
BITS, BROADCAST, SALTS = 1 << 24, 1 << 18, 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_keys(texts: list[str | None]) -> tuple[list[str], Stream, np.ndarray, np.ndarray, np.ndarray]:
    lower = [t.lower() if t else "" for t in texts]
    stream = Stream(lower)
    begin, end = stream.words()
    return lower, stream, begin, end, stream.keys(begin, end) if len(begin) else np.zeros(0, np.uint64)


def _shingles(keys: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words inside one text, text of each)."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = (h ^ keys[j : j + n]) * _MIX
        h ^= h >> np.uint64(31)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = owner[:n] == owner[width - 1 :]
    return h[whole], owner[:n][whole]


def _words(text: str, base: int, begin: np.ndarray, end: np.ndarray) -> list[str]:
    return [text[a - base : b - base] for a, b in zip(begin.tolist(), end.tolist())]


def _grams(words: list[str], k: int) -> set[tuple]:
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}


def sketches(items: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """item_row, k (words a shingle), n (distinct shingles), part (power of two above n) and hash (signed), one row for
    each hash of each item's sketch. items: item_row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for lo, hi in chunks(texts):
                _, stream, begin, _, keys = _word_keys(texts[lo:hi])
                at = stream.per_text(begin)
                for i in range(hi - lo):
                    n = int(at[i + 1] - at[i])
                    k = min(width, n)
                    if k:
                        own = np.unique(_shingles(keys[at[i] : at[i + 1]], np.array([0, n]), k)[0])
                        # floor with room for the rounding of 1 - least
                        out += [(rows[lo + i], k, len(own), len(own).bit_length(), h) for h in own[: int((1 - least) * len(own) + 1e-9) + 1].view(np.int64).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["item_row", "k", "n", "part", "hash"])

    return items.select("item_row", "text").mapInArrow(run, "item_row bigint, k int, n int, part int, hash bigint")


def _place(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(40)).astype(np.int64) % BITS


class Probe:
    """What every task gets of the sketches, of a fixed size: limits by width and partition, and the bit map."""

    def __init__(self, limits: list[tuple], bits: np.ndarray, least: float):
        self.limits: dict[int, list[tuple[int, int]]] = {}  # k: (shingles that a document needs, limit)
        for k, n, high in limits:
            self.limits.setdefault(k, []).append((int(np.ceil(least * n - 1e-9)), int(high)))
        self.bits = bits

    def signatures(self, texts: list[str | None]) -> dict[int, list[tuple[int, int]]]:
        """(k, hash) of each text's signature that the bit map lets through, by text number."""
        _, stream, begin, _, keys = _word_keys(texts)
        at = stream.per_text(begin)
        out: dict[int, list[tuple[int, int]]] = {}
        for k, parts in self.limits.items():
            h, owner = _shingles(keys, at, k)
            if not len(h):
                continue
            count = np.bincount(owner, minlength=len(texts))
            limit = np.zeros(len(texts), np.uint64)
            for need, high in parts:
                limit = np.where(count >= need, np.maximum(limit, np.uint64(high)), limit)
            low = np.flatnonzero(h <= limit[owner])
            low = low[np.unpackbits(self.bits[_place(h[low]) >> 3].reshape(-1, 1), axis=1, bitorder="little")[np.arange(len(low)), _place(h[low]) & 7] == 1] if len(low) else low
            for i, x in set(zip(owner[low].tolist(), h[low].view(np.int64).tolist())):
                out.setdefault(i, []).append((k, x))
        return out


def _probe(found: DataFrame, least: float) -> Probe:
    """found: sketches. Hashes compare as unsigned numbers: their order is that of the signed ones with the sign turned."""
    turned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    limits = [(r.k, r.n, (r.high + (1 << 63)) % (1 << 64)) for r in found.groupBy("k", "part").agg(F.min("n").alias("n"), F.max(turned).alias("high")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array((1 << (at & 7)).astype(np.int32))], ["byte", "bit"])

    table = found.select("hash").mapInArrow(run, "byte bigint, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(BITS // 8, np.uint8)
    bits[table["byte"].to_numpy()] = table["bit"].to_numpy().astype(np.uint8)
    return Probe(limits, bits, least)


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(verified hits: row, id, text, item_row, shared, containment; items: item_row, item)."""
    spark = docs.sparkSession
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    texts = cut(known.select("text").distinct().withColumn("item_row", F.monotonically_increasing_id()), "items")
    found = cut(sketches(texts, width, least), "sketches")
    shared = spark.sparkContext.broadcast(_probe(found, least))
    kind = docs.schema[id_col].dataType.simpleString()
    pair = pa.list_(pa.struct([("k", pa.int32()), ("hash", pa.int64())]))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            for lo, hi in chunks(own):
                hit = shared.value.signatures(own[lo:hi])
                if hit:
                    at = sorted(hit)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array([lo + i for i in at])) for c in (0, 1)), pa.array([[{"k": k, "hash": h} for k, h in hit[i]] for i in at], pair)], ["id", "text", "hits"])

    held = docs.select(id_col, text_col).mapInArrow(suspects, f"id {kind}, text string, hits array<struct<k:int,hash:bigint>>")
    held = cut(held.withColumn("row", F.monotonically_increasing_id()), "suspects")
    keyed = held.select("row", F.inline("hits"))
    if found.count() <= BROADCAST:
        pairs = keyed.join(F.broadcast(found.select("k", "hash", "item_row")), ["k", "hash"])
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        pairs = keyed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(found.select("k", "hash", "item_row", salt), ["k", "hash", "salt"])
    pairs = pairs.select("row", "item_row").distinct().join(texts.withColumnRenamed("text", "item_text"), "item_row")
    # All items of a document are verified against its words at once: they are distinct texts that share a shingle with it.
    asked = held.select("row", "id", "text").join(pairs.groupBy("row").agg(F.collect_list(F.struct("item_row", "item_text")).alias("asked")), "row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (text, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                lower, stream, begin, end, _ = _word_keys([text, *(x["item_text"] for x in asked)])
                at = stream.per_text(begin)
                part = lambda j: _words(lower[j], int(stream.text_at[j]), begin[at[j] : at[j + 1]], end[at[j] : at[j + 1]])  # noqa: B023, E731
                own, have = part(0), {}
                for j, x in enumerate(asked, 1):
                    words = part(j)
                    k = min(width, len(words))
                    want = _grams(words, k)
                    if k not in have:
                        have[k] = _grams(own, k)
                    both = len(want & have[k])
                    if both >= least * len(want) - 1e-9:
                        out.append((i, x["item_row"], both, both / len(want)))
            if out:
                at, rows, both, share = zip(*out)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (0, 1, 2)), pa.array(rows, pa.int64()), pa.array(both, pa.int32()), pa.array(share, pa.float64())], ["row", "id", "text", "item_row", "shared", "containment"])

    hits = asked.mapInArrow(verify, f"row bigint, id {kind}, text string, item_row bigint, shared int, containment double")
    return hits, known.join(texts, "text").select("item_row", "item")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``id_col``, ``item_col``, shared and containment for each document and item of containment ``least`` or more."""
    hits, members = _hits(docs, items, id_col, text_col, item_col, item_text, width, least)
    return hits.select("id", "item_row", "shared", "containment").join(members, "item_row").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "shared", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The documents, all columns, without those that hold an item. They are told by hashes of id and text."""
    hits, _ = _hits(docs, items, id_col, text_col, item_col, item_text, width, least)
    gone = cut(hits.select(F.xxhash64("id").alias("__id"), F.xxhash64("text").alias("__text")).distinct(), "contaminated")
    return docs.join(gone, (F.xxhash64(docs[id_col]) == gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__text"]), "left_anti")
