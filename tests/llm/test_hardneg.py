"""Hard negatives against all pairs in Python's whole numbers."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=5, least=80, most=100):
    kept = {(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and None not in v and np.isfinite(v).all()}
    anchors = {}
    for i, l, v in kept:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (len(v), l, v)), (len(v), l, v))
    out, cap = [], lambda x: max(-(2**63), min(2**63 - 1, x))
    for i, (n, l, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i and len(w) == n)
        for s, p, _ in [r for r in scored if r[2] == l][:positives]:
            hard = [(-t, j) for t, j, m in scored if m != l and least * -s <= most * -t <= most * -s][:negatives]
            out += [(i, p, r, j, cap(-s), cap(t)) for r, (t, j) in enumerate(hard, 1)]
    return sorted(out)


def taken(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def anchors():
    return F.col("vec_id") % 10 == 0


@pytest.mark.parametrize("spread, scale", [(2, 256), (200, 256), (2**20, 1), (2**40, 2.0**-40)])
def test_against_all_pairs(spark, spread, scale):
    """Small spreads tie; large ones leave single and double precision and 64 bits. A third of the rows is one label."""
    rng = np.random.default_rng(spread % 97)
    rows = [(i, [float(x) / scale for x in rng.integers(-spread, spread + 1, 5)], int(rng.integers(0, 4)) if i % 3 else 1) for i in range(240)]
    rows += [(20, [0.0] * 5, 2), (20, [0.5] * 5, 1), (20, [0.5] * 5, 1), (30, [1.0] * 5, 3), (300, None, 1), (310, [0.1] * 5, None), (320, [None] * 5, 1), (330, [float("nan")] * 5, 1), (340, [0.5, 0.5], 1), (341, [0.5, 0.25], 1), (342, [0.25, 0.5], 2), (350, [], 1), (351, [], 1), (352, [], 2), (None, [0.5] * 5, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "v": F.lit(2), "dim": F.lit(3), "block": F.lit(4), "asked": F.lit(False), "anchor": F.lit("x")})
    want = plain(rows)
    assert want and taken(hardneg.mine(df, anchors())) == want
    assert taken(hardneg.mine(df, anchors(), block=16, batch=4)) == want
    assert taken(hardneg.mine(df, anchors(), positives=2, negatives=30, least=10, block=50)) == plain(rows, 2, 30, 10)


def test_none(spark):
    df = spark.createDataFrame([(0, [0.5], 1), (1, [0.5], 1), (2, [0.45], 2)], SCHEMA)
    assert taken(hardneg.mine(df, anchors())) == plain([(0, [0.5], 1), (1, [0.5], 1), (2, [0.45], 2)]) != []
    for where in ("false", "vec_id > 0", "vec_id = 0", "label = 1"):
        assert hardneg.mine(df.where(where), anchors()).count() == 0


@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-(2**70), 2**70) | st.integers(-5, 5) | st.sampled_from([2**63 - 1, 2**63, -(2**63), -(2**63) - 1]), st.integers(0, 1), st.integers(-4, 4)), max_size=30))
def test_keys_sort_as_rows_do(rows):
    keys = [hardneg.pack(*r) for r in rows]
    assert [hardneg.unpack(k) for k in keys] == rows
    assert [hardneg.unpack(k) for k in sorted(keys)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
