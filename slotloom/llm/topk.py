"""Exact top-k by inner product, without random access.

Vectors are turned to integers floor(scale * x). Rows are dealt to blocks by id; queries are dealt to batches; each
(block, batch) cell aggregates on its own and the cells' answers are merged. In a cell every dimension is a list of
(row, value) sorted by value, read in order from the end that the sign of the query's weight favours. Each round reads
all lists on to the next of DEPTHS. A row's lower bound is what was read of it, with the least value of each list for
what was not; its upper bound takes the value at the list's frontier instead. Rows whose upper bound is under the query's
k-th lower bound cannot qualify; a query stops reading when no more than 2 k rows can, and the scores of those are then
resolved. A list is read to its end only by queries that have not stopped before. ``Reading`` tells how far they went.

Null, empty and non-finite vectors take no part, nor do vectors with null or non-finite components or rows without id;
vectors of another length than the query's are not compared. Rows that share the query's id are its own and no
candidates; other rows that repeat an id each count. A query id that repeats is asked once, with its least vector. Fewer
than k candidates: all. Ties go to the smaller id. Where scores may pass 2**52, bounds are widened by their rounding and
scores resolved in whole numbers; scores beyond 64 bits are ranked exactly and put out as the nearest long. Empty tables
give no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a batch at most, numbers in a block at most, queries that read together.
BLOCK, BATCH, NUMBERS, TOGETHER = 8192, 4096, 1 << 22, 256
#: Shares of each list that are read after each round.
DEPTHS = (1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


@dataclass
class Reading:
    """What a run of ``nra`` read: for each query the share of its lists' entries, and the rows left to resolve."""

    share: list[float] = field(default_factory=list)
    resolved: list[int] = field(default_factory=list)


def nra(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray, tell: Reading | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, row numbers, scores) for each row of q: rows of x that hold its k best and all that tie with the
    k-th. own[i, j]: whether row j of x is query i's own. x, q: whole numbers as floats."""
    n, m = len(x), len(q)
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, 0)
    bound = float(np.abs(x).max(initial=1)) * float(np.abs(q).max(initial=1)) * max(1, x.shape[1])
    slack = bound * 4 * x.shape[1] * 2.0**-52 if bound >= 2**52 else 0.0
    dims = np.arange(x.shape[1])
    least, most = lists[0], lists[-1]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    both = np.concatenate([plus, minus], 1)
    lower = np.repeat((plus @ least + minus @ most)[:, None], n, 1)
    seen = np.zeros((n, 2 * x.shape[1]), x.dtype)  # top and bottom ends that have come by
    live = np.arange(m)
    last = 0
    for depth in DEPTHS:
        now = n if depth == 1.0 else max(last, int(depth * n))
        if now == last:
            continue
        # Entries last .. now - 1 of every list, counted from either end, go to the rows that they name.
        fresh = np.zeros_like(seen)
        top, bottom = slice(n - now, n - last), slice(last, now)
        fresh[order[top], dims] = lists[top] - least
        fresh[order[bottom], dims + x.shape[1]] = lists[bottom] - most
        seen[order[top], dims] = seen[order[bottom], dims + x.shape[1]] = 1
        last = now
        lower += both[live] @ fresh.T
        # An unread entry is worth at most its list's frontier: the gap to the value taken for it in the lower bound.
        gap = np.concatenate([lists[n - now] - least, lists[now - 1] - most])
        upper = lower + both[live] @ ((1 - seen) * gap).T if now < n else lower
        stay = []
        for i, at in enumerate(live.tolist()):
            mine = own[at]
            low = np.where(mine, -np.inf, lower[i])
            take = min(k, n - int(mine.sum()))
            floor = np.partition(low, n - take)[n - take] if take else np.inf
            able = np.flatnonzero((upper[i] >= floor - slack) & ~mine)
            if now < n and len(able) > 2 * take:
                stay.append(i)
                continue
            if tell is not None:
                tell.share.append(now / n)
                tell.resolved.append(len(able))
            if slack:
                whole = [int(v) for v in q[at]]
                score = np.array([sum(int(a) * b for a, b in zip(x[j], whole)) for j in able.tolist()], object)
            else:
                score = x[able] @ q[at]
            yield at, able, score
        if not stay:
            return
        live, lower = live[stay], lower[stay]


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query over all other rows, ties to the smaller id."""
    pick = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"))
    rows, asked = pick(vectors), pick(queries)
    n_rows, widest = rows.agg(F.count("*"), F.max("dim")).first()
    block = max(64, min(block, NUMBERS // max(1, widest or 1)))
    asked = asked.groupBy("id", "dim").agg(F.min("v").alias("v"))
    blocks, batches_ = max(1, -(-n_rows // block)), max(1, -(-asked.count() // batch))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    # Rows of a hot id would meet in one block: they are dealt by their vectors too.
    left = rows.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(batches_ - 1))).alias("batch"), "id", "v")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(batches_, 2).alias("batch"), "id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("high", pa.float64())])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        a, b = a.combine_chunks(), b.combine_chunks()
        names, x = a["id"].to_numpy(), _matrix(a["v"].combine_chunks(), scale)
        asks, q = b["id"].to_numpy(), _matrix(b["v"].combine_chunks(), scale)
        if max(1.0, np.abs(x).max()) * max(1.0, np.abs(q).max()) * x.shape[1] < 2**22:  # sums are exact in this precision
            x, q = x.astype(np.float32), q.astype(np.float32)
        out = []
        for lo in range(0, len(asks), TOGETHER):
            own = names[None, :] == asks[lo : lo + TOGETHER, None]
            for at, found, score in nra(x, q[lo : lo + TOGETHER], k, own):
                best = sorted(zip((-score).tolist(), names[found].tolist()))[:k]
                out += [(int(asks[lo + at]), i, max(-(1 << 63), min((1 << 63) - 1, int(-s))), float(-s)) for s, i in best]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else schema.empty_table()

    found = left.groupBy("dim", "block", "batch").cogroup(right.groupBy("dim", "block", "batch")).applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint, high double")
    best = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
