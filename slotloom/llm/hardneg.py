"""Hard negatives by a secondary sort.

Scores are whole-number inner products. A row of an anchor is packed into one binary key: anchor, falling score, kind
(positives first among equals), id; keys compare byte by byte. Rows are dealt by anchor and sorted within partitions by that
key, and an iterator streams each partition: a positive opens a window, and every negative that follows goes to all open
windows until it is full or the scores have fallen below its least share. An anchor's rows are never held; the state is
its open windows, ``positives`` at most.

Only rows that may count are shuffled. Rows and anchors meet in cells (a block of rows, a batch of anchors), first by label:
a cell gives each anchor its best rows of the anchor's label, and the best of all cells are the positives. Then all labels
meet; the anchors bring the scores of their positives, and a cell keeps, for each window, its first ``negatives`` rows in it.
A window's first rows overall are among the first of their cells, so nothing is lost; at most (cells x windows x negatives)
rows an anchor go on. Scoring all rows against all anchors is inherent in the task; copies a row are one a batch, copies
an anchor one a block.

Rows with a null id or label, a null vector, or any null or non-finite component take no part. Rows equal in id, label and
vector count once. Where an id repeats with other labels or vectors, the least is the anchor, and no row of the anchor's id
is its positive or negative. Vectors of different lengths are not compared; empty vectors score 0 with each other. A
positive of a negative score has no negatives (its window is empty). Scores are exact at any size; beyond 64 bits they are
put out as the nearest long. Empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.llm.store import cut
from slotloom.llm.topk import usable
from slotloom.llm.vectors import DOUBLE, SINGLE, floors, largest, whole

#: Rows of a block and anchors of a batch at most, numbers in a block at most, the least rows of a block, anchors scored at once.
BLOCK, BATCH, NUMBERS, LEAST, TOGETHER = 32768, 8192, 1 << 21, 1024, 64
POSITIVE, NEGATIVE = 0, 1
_TOP, _WIDE = 1 << 63, (1 << 64) - 1


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Sorts by anchor, falling score, kind, id. A score is its sign and number of bytes (eight, or more where needed), then
    its bytes, all inverted."""
    size = 8 if -_TOP <= score < _TOP else (score.bit_length() + 8) // 8
    head, body = (0x8000 + size, score) if score >= 0 else (0x8000 - size, score + (1 << 8 * size))
    return (anchor + _TOP).to_bytes(8, "big") + (0xFFFF - head).to_bytes(2, "big") + ((1 << 8 * size) - 1 - body).to_bytes(size, "big") + bytes([kind]) + (row + _TOP).to_bytes(8, "big")


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, kind, id)."""
    head = 0xFFFF - int.from_bytes(key[8:10], "big")
    size = abs(head - 0x8000)
    score = (1 << 8 * size) - 1 - int.from_bytes(key[10 : 10 + size], "big")
    return int.from_bytes(key[:8], "big") - _TOP, score if head > 0x8000 else score - (1 << 8 * size), key[10 + size], int.from_bytes(key[11 + size :], "big") - _TOP


def floor_score(score: int, least: int, most: int) -> int:
    """The least whole score n with least * score <= most * n."""
    return -(-least * score // most)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k places by falling score, then id."""
    if len(score) > 4 * k and score.dtype != object:
        score_k = np.partition(score, len(score) - k)[len(score) - k]
        able = np.flatnonzero(score >= score_k)
    else:
        able = np.arange(len(score))
    return able[np.lexsort((ids[able], -score[able]))[:k]] if score.dtype != object else np.array(sorted(able.tolist(), key=lambda i: (-score[i], ids[i]))[:k], np.int64)


def _matrices(a: pa.ChunkedArray, b: pa.ChunkedArray, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' vectors in the smallest type in which their inner products are exact."""
    a, b = a.combine_chunks(), b.combine_chunks()
    x, q = floors(a, dim, scale), floors(b, dim, scale)
    bound = max(1, largest(x)) * max(1, largest(q)) * max(1, dim)
    if bound >= DOUBLE:
        return whole(a, dim, scale), whole(b, dim, scale)
    return (x.astype(np.float32), q.astype(np.float32)) if bound < SINGLE else (x, q)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as numbers, equal where the labels are."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


KEYS = pa.schema([("anchor", pa.int64()), ("key", pa.binary())])


def _keys(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(KEYS.types)], schema=KEYS)


def _same_label(k: int, scale: float):
    """Cell of one label: each anchor's k best rows."""

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return KEYS.empty_table()
        x, q = _matrices(a["v"], b["v"], a["dim"][0].as_py(), scale)
        ids, anchors, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        for lo in range(0, len(q), TOGETHER):
            for anchor, score in zip(anchors[lo : lo + TOGETHER].tolist(), q[lo : lo + TOGETHER] @ x.T):
                other = np.flatnonzero(ids != anchor)
                best = other[_first(score[other], ids[other], k)]
                out += [(anchor, pack(anchor, int(score[i]), POSITIVE, int(ids[i]))) for i in best.tolist()]
        return _keys(out)

    return cell


def _in_windows(k: int, least: int, most: int, scale: float):
    """Cell of all labels: for each window of each anchor the first k rows of other labels in it."""

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return KEYS.empty_table()
        x, q = _matrices(a["v"], b["v"], a["dim"][0].as_py(), scale)
        ids, anchors, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        labels, own = _codes(a["label"], b["label"])
        positives = [[unpack(p)[1] for p in keys] for keys in b["positives"].to_pylist()]
        for lo in range(0, len(q), TOGETHER):
            for i, score in enumerate(q[lo : lo + TOGETHER] @ x.T, lo):
                windows = sorted({(floor_score(p, least, most), p) for p in positives[i] if p >= 0})
                if not windows:
                    continue
                anchor = int(anchors[i])
                able = np.flatnonzero((score >= windows[0][0]) & (score <= windows[-1][1]) & (labels != own[i]) & (ids != anchor))
                value, kept = score[able], set()
                for low, high in windows:
                    inside = able[((value >= low) & (value <= high)).astype(bool)]
                    kept.update(inside[_first(score[inside], ids[inside], k)].tolist())
                out += [(anchor, pack(anchor, int(score[j]), NEGATIVE, int(ids[j]))) for j in kept]
        return _keys(out)

    return cell


def windows_of(keys: Iterator[bytes], k: int, least: int, most: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from keys in sorted order."""
    anchor, open_ = None, []
    for key in keys:
        at, score, kind, row = unpack(key)
        if at != anchor:
            anchor, open_ = at, []
        if kind == POSITIVE:
            open_.append([floor_score(score, least, most), row, score, 0])
            continue
        open_ = [w for w in open_ if w[0] <= score and w[3] < k]
        for w in open_:
            w[3] += 1
            yield at, w[1], w[3], row, w[2], score


def _long(score: int) -> int:
    return max(-_TOP, min(_TOP - 1, score))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (rows where ``anchors``
    holds) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels with
    least * positive_score <= most * negative_score <= most * positive_score. 0 < least <= most."""
    spark = rows.sparkSession
    able = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col))
    picked = rows.where(able).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"), anchors.alias("asked"))
    own = cut(picked.distinct(), "vectors")
    asked = cut(own.where("asked").groupBy("id").agg(F.min(F.struct("dim", "label", "v")).alias("a")).select("id", "a.*"), "anchors")
    n_rows, n_asked, widest = own.agg(F.count("*"), F.count_if("asked"), F.max("dim")).first()
    block = min(block, max(LEAST, n_rows // (2 * spark.sparkContext.defaultParallelism)), max(1, NUMBERS // max(1, widest or 1)))
    blocks, batches = max(1, -(-n_rows // block)), max(1, -(-n_asked // batch))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = own.select("dim", "label", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), every(batches).alias("batch"), "id", "v")
    deal = F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch")
    meet = lambda near, keys, cell: left.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(cell, "anchor bigint, key binary")

    near = asked.select("dim", "label", every(blocks).alias("block"), deal, "id", "v")
    best = meet(near, ("dim", "label", "block", "batch"), _same_label(positives, scale))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy("key"))).where(F.col("rank") <= positives)
    best = cut(best.select("anchor", "key"), "positives")
    # At most ``positives`` keys an anchor.
    held = asked.join(best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("key").alias("positives")), "id")
    near = held.select("dim", "label", every(blocks).alias("block"), deal, "id", "v", "positives")
    hard = meet(near, ("dim", "block", "batch"), _in_windows(negatives, least, most, scale))

    def stream(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = [], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

        def out() -> pa.RecordBatch:
            columns = zip(*found) if found else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names)

        for r in windows_of((k.as_py() for b in batches_ for k in b.column(0)), negatives, least, most):
            found.append((*r[:4], _long(r[4]), _long(r[5])))
            if len(found) == 8192:
                yield out()
                found = []
        yield out()

    dealt = best.union(hard).repartition("anchor").sortWithinPartitions("key").select("key")
    return dealt.mapInArrow(stream, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
