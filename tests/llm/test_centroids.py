"""Clustering against plain k-means in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, dim, rounds, scale=256.0):
    """Sorted (id, cluster, distance, inertia of the cluster, inertia, centroid)."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    cs = [v for *_, v in start]
    if not cs:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        cs = [[sum(x) // len(own) for x in zip(*own)] if (own := [v for (_, v), a in zip(kept, at) if a == j]) else c for j, c in enumerate(cs)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    own = {j: sum(d for _, a, d in got if a == j) for j in range(len(cs))}
    cap = lambda x: min(x, 2**63 - 1)
    if any(d > 2**63 - 1 for _, _, d in got):
        got = [(i, j, cap(d)) for i, j, d in got]
        own = {j: cap(sum(d for _, a, d in got if a == j)) for j in own}
    total = cap(sum(own.values()))
    return sorted((str(i), j, d, own[j], total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in got)


def taken(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


ODD = [(None, [0.1] * 6), (900, None), (901, [0.1, None] * 3), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [0.5] * 5), (905, []), (7, [0.25] * 6), (7, [0.25] * 6), (7, [-0.5] * 6)]


@pytest.mark.parametrize("width, k, n", [(1, 5, 200), (2, 40, 300), (40, 12, 300), (300, 40, 30)])
def test_against_plain_k_means(spark, width, k, n):
    """Few distinct values give ties and empty clusters; the odd rows hold nulls, repeats and other lengths."""
    rng = np.random.default_rng(width)
    rows = [(i, [float(x) / 256 for x in rng.integers(-width, width + 1, 6)]) for i in range(n)] + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "v": F.lit("x"), "cluster": F.lit(3), "distance": F.lit(2.5)})
    assert taken(centroids.cluster(df, k=k, dim=6, rounds=3)) == plain(rows, k, 6, 3)


def test_huge_values_none_and_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) * 2.0**e for x in rng.integers(-8, 9, 3)]) for i, e in enumerate(np.repeat([0, 20, 60, 110], 8).tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    assert taken(centroids.cluster(df, k=6, dim=3, rounds=2)) == plain(rows, 6, 3, 2)
    assert taken(centroids.cluster(df.limit(1), k=6, dim=3)) == plain(rows[:1], 6, 3, 5)
    assert centroids.cluster(df.where("false"), k=6, dim=3).count() == 0
    nameless = spark.createDataFrame([(None, [0.5] * 3)], SCHEMA)
    assert centroids.cluster(nameless, k=6, dim=3).count() == 0
    doubles = spark.createDataFrame([(1, [0.1, 1e300]), (2, [0.3, -1e308])], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in centroids.cluster(doubles, k=2, dim=2).collect()) == [1, 2]


def test_orchard_finds_the_nearest_and_skips_far_ones():
    rng = np.random.default_rng(8)
    for spread in (2, 30, 1000):
        c = np.concatenate([rng.integers(-spread, spread + 1, (30, 4)), rng.integers(-spread, spread + 1, (10, 4)).repeat(2, 0)]).astype(float)
        x = (c[rng.integers(0, len(c), 500)] + rng.integers(-3, 4, (500, 4))).astype(float)
        at, dist, measured = centroids.orchard(x, c, *centroids.neighbours(c), start=int(rng.integers(len(c))))
        full = ((x[:, None] - c) ** 2).sum(2)
        assert at.tolist() == full.argmin(1).tolist() and dist.tolist() == full.min(1).tolist()
    assert measured < 0.5 * full.size  # far apart clusters: most centroids are never measured
