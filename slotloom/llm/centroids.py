"""Centroid clustering (k-means) over whole-number vectors, with Orchard's search for the nearest centroid.

Every centroid has the list of all others by rising distance from it. A vector starts at a centroid and walks along its
list: a centroid met for the first time is measured; if it is closer (or as close and of a smaller number), the walk jumps
to the head of that one's list. It ends at the first entry strictly beyond twice the present distance: by the triangle
inequality all from there on are farther away than the present one. Distances are compared squared (over four times), in
whole numbers, so ties are seen as ties. ``orchard`` walks all vectors of a batch in step.

Each round is one pass over the table: a task adds up counts and component sums of its clusters, sums are split into
limbs of 32 bits, and one row a (centroid, component, limb) reaches the driver, as many as the centroids have numbers.
Centroids (k times the length) are broadcast. Nothing is kept between rounds, so a lost executor costs its tasks only.

Vectors of another length, null ones and ones with null or non-finite components take no part. Rows that repeat an id or a
vector each count. Rows without id take part, but never start a centroid. Fewer vectors than k: as many centroids as
there are rows with ids (none: no rows). Equal starting hashes go by id, then vector. Distances and inertias beyond 64 bits are put
out as the largest long; they are compared exactly. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.llm.store import cut
from slotloom.llm.vectors import DOUBLE, SINGLE, complete, floors, largest, whole

#: Vectors that walk together.
TOGETHER = 4096
LIMB = 32
LONG = (1 << 63) - 1

Centroids = list[list[int]]


def _squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1) if a.dtype == object else np.einsum("...i,...i->...", a, a)


def neighbours(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of all other centroids of each one, nearest first, ties by number."""
    k = len(c)
    gap = np.stack([_squares(c - x) for x in c]) if k else np.zeros((0, 0))
    order = np.array([sorted((j for j in range(k) if j != i), key=lambda j, i=i: (gap[i, j], j)) for i in range(k)], np.int64).reshape(k, max(k - 1, 0))
    return order, np.take_along_axis(gap, order, 1)


def orchard(x: np.ndarray, c: np.ndarray, near: np.ndarray, gap: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector and the number of distances measured. x and c: whole numbers of one
    type in which squared distances are exact."""
    n, k = len(x), len(c)
    at = np.full(n, start)
    dist = _squares(x - c[start])
    seen = np.zeros((n, k), bool)
    seen[:, start] = True
    place, measured = np.zeros(n, np.int64), n
    walk = np.arange(n)
    while len(walk):
        walk = walk[place[walk] < k - 1]
        own, step = at[walk], place[walk]
        on = (gap[own, step] <= 4 * dist[walk]).astype(bool)
        walk, own, step = walk[on], own[on], step[on]
        place[walk] = step + 1
        met = near[own, step]
        new = ~seen[walk, met]
        row, met = walk[new], met[new]
        seen[row, met] = True
        measured += len(row)
        found = _squares(x[row] - c[met])
        closer = ((found < dist[row]) | ((found == dist[row]) & (met < at[row]))).astype(bool)
        row, met = row[closer], met[closer]
        at[row], dist[row], place[row] = met, found[closer], 0
    return at, dist, measured


class Search:
    """Nearest centroids of Arrow lists, in the smallest type of number that is exact."""

    def __init__(self, centroids: Centroids, scale: float):
        self.centroids, self.scale, self.dim = centroids, scale, len(centroids[0])
        self.most = max((abs(v) for c in centroids for v in c), default=0)
        self.tables: dict[type, tuple] = {}

    def _table(self, kind: type) -> tuple:
        if kind not in self.tables:
            c = np.array(self.centroids, kind).reshape(len(self.centroids), self.dim)
            self.tables[kind] = (c, *neighbours(c))
        return self.tables[kind]

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vectors, centroids, squared distances) of runs of vectors."""
        for lo in range(0, len(column), TOGETHER):
            part = column.slice(lo, TOGETHER)
            x = floors(part, self.dim, self.scale)
            bound = self.dim * (largest(x) + self.most) ** 2  # four times a float is as exact
            kind = np.float32 if bound < SINGLE else np.float64 if bound < DOUBLE else object
            x = x.astype(kind) if kind is not object else whole(part, self.dim, self.scale)
            at, dist, _ = orchard(x, *self._table(kind))
            yield x, at, dist


def _limbs(total: int) -> list[int]:
    out, sign, rest = [], -1 if total < 0 else 1, abs(total)
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _picked(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = rows.select(vector_col).dtypes[0][1]
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v"))


def _starts(kept: DataFrame, k: int, dim: int, scale: float, salt: str) -> Centroids:
    """The k vectors whose ``salt`` and id have the least hashes, in their order."""
    usable = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    first = kept.where(F.col("id").isNotNull() & usable).withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)).orderBy("h", "id", "v").limit(k).select("h", "id", "v").toArrow().combine_chunks()
    rows = sorted(zip(first["h"].to_pylist(), first["id"].to_pylist(), first["v"].to_pylist()))
    return whole(pa.array([r[2] for r in rows], pa.list_(pa.float64())), dim, scale).tolist() if rows else []


def _sums(kept: DataFrame, centroids: Centroids, scale: float) -> tuple[list[int], Centroids]:
    """Counts and exact component sums of each centroid's vectors."""
    k, dim = len(centroids), len(centroids[0])
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, scale)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            own = batch.column(1)
            for x, at, _ in search(own.take(pa.array(complete(own, dim)))):
                count += np.bincount(at, minlength=k)
                if x.dtype == object:
                    np.add.at(total, at, x)
                else:  # the sums of one run are exact as doubles: sizes are under 2**26, rows under 2**13
                    member = np.zeros((k, len(at)))
                    member[at, np.arange(len(at))] = 1
                    total += (member @ x.astype(np.float64)).astype(np.int64).astype(object)
        rows = [(i, -1, 0, int(n)) for i, n in enumerate(count) if n] + [(i, j, l, v) for i in np.flatnonzero(count).tolist() for j in range(dim) for l, v in enumerate(_limbs(int(total[i, j])))]
        yield pa.RecordBatch.from_arrays([pa.array([r[m] for r in rows], kind) for m, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "at", "limb", "value"])

    added = kept.mapInArrow(run, "cluster int, at int, limb int, value bigint").groupBy("cluster", "at", "limb").agg(F.sum("value").alias("value"))
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    for r in added.collect():
        if r["at"] < 0:
            counts[r["cluster"]] = r["value"]
        else:
            sums[r["cluster"]][r["at"]] += r["value"] << (LIMB * r["limb"])
    return counts, sums


def learn(rows: DataFrame, k: int = 40, dim: int = 64, scale: float = 256.0, rounds: int = 5, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> Centroids:
    """The centroids after ``rounds`` rounds: each assigns all vectors and moves every centroid that has any to the floor of
    their mean."""
    kept = _picked(rows, id_col, vector_col)
    centroids = _starts(kept, k, dim, scale, salt)
    for _ in range(rounds if centroids else 0):
        counts, sums = _sums(kept, centroids, scale)
        centroids = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, centroids)]
    return centroids


def assign(rows: DataFrame, centroids: Centroids, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, cluster and distance (squared) of every vector of the centroids' length."""
    kept = _picked(rows, id_col, vector_col)
    schema = f"`{id_col}` bigint, cluster int, distance bigint"
    if not centroids:
        return rows.sparkSession.createDataFrame([], schema)
    shared, dim = rows.sparkSession.sparkContext.broadcast(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, scale)
        for batch in batches:
            good = pa.array(complete(batch.column(1), dim))
            found = [(at, [min(LONG, int(d)) for d in dist]) for _, at, dist in search(batch.column(1).take(good))]
            at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), pa.array(at.astype(np.int32)), pa.array([d for _, ds in found for d in ds], pa.int64())], [id_col, "cluster", "distance"])

    return kept.mapInArrow(run, schema)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONG).cast("decimal(38,0)")).cast("bigint")


def cluster(rows: DataFrame, k: int = 40, dim: int = 64, scale: float = 256.0, rounds: int = 5, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector: learns the centroids and
    assigns all vectors to them once more."""
    spark = rows.sparkSession
    centroids = learn(rows, k, dim, scale, rounds, salt, id_col, vector_col)
    own = cut(assign(rows, centroids, scale, id_col, vector_col), "assigned")
    sums = own.groupBy("cluster").agg(_long(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)")).alias("total")).collect()
    inertia = min(LONG, sum(r["total"] for r in sums))
    # One row a centroid.
    facts = spark.createDataFrame([(r["cluster"], r["total"], inertia, digest(centroids[r["cluster"]])) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return own.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
