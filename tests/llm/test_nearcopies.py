"""The pipeline's near copies against all pairs."""

import random
import re

import numpy as np
import corpus_pipeline
from pyspark.sql import functions as F

from slotloom.llm import nearcopies

from tests.llm.test_llm import plain_fingerprint

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(docs):
    sets, fps = [shingles(t) for _, t in docs], [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            alike = sets[i] == sets[j] or (min(a, b) >= 0.8 * max(a, b) and (both := len(sets[i] & sets[j])) >= 0.8 * (a + b - both))
            if alike or bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(docs))


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {c for _, c in components(rows)}
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert got == want and len(want) < 927  # 927 texts differ in their shingles


def test_crowded_and_odd(spark):
    """Groups of near copies that chain, texts that share a passage only, and odd texts, with every key crowded."""
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(5000))
    base, passage = [[word() for _ in range(80)] for _ in range(3)], [word() for _ in range(30)]
    docs = []
    for b in base:
        for _ in range(40):
            t = list(b)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(80)] = word()
            docs.append(" ".join(t))
    docs += [" ".join(passage + [word() for _ in range(12)]) for _ in range(60)]
    docs += [None, "", " ", "one", "ONE", "one two", "one two three four five", "One two\nthree four five", "é ñ", "é ñ"]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for paired in (1, 4, 32):
        assert sorted((r.id, r.component.id) for r in nearcopies.near_copies(df, paired=paired).collect()) == components(docs)
    assert nearcopies.near_copies(df.where("false")).count() == 0


def test_prefixes_lose_no_link(spark):
    """Pairs near the threshold that share a passage with all others, every key crowded and no minimum telling."""
    rng = random.Random(7)
    word = lambda: "v" + str(rng.randrange(9000))
    passage, docs = [word() for _ in range(60)], []
    for _ in range(30):
        own = [word() for _ in range(rng.randrange(20, 70))]
        docs.append(" ".join(own + passage))
        for _ in range(3):
            t = list(own)
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = word()
            docs.append(" ".join(t + passage))
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.id, r.component.id) for r in nearcopies.near_copies(df, paired=2).collect()) == components(docs)


def passage_sets(n):
    """Sets that share one passage of 900 shingles: even ones with 100 of their own, odd ones with 200."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    return [np.sort(np.concatenate([passage, rng.integers(0, 1 << 63, 100 + i % 2 * 100, dtype=np.uint64)])) for i in range(n)]


def test_a_passage_makes_no_pairs(spark):
    """Even sets are one component by the passage (0.82), odd ones are 0.75 alike to them and 0.69 to each other."""
    for n in (500, 1000):
        rows = [(i, 0 if i % 2 == 0 else i, x.tobytes()) for i, x in enumerate(passage_sets(n))]
        pairs = nearcopies._across(spark.createDataFrame(rows, "cls long, root long, shingles binary"), 0.8)
        assert pairs.count() <= n


def test_across_loses_no_pair(spark):
    """Sets of many sizes around one passage, some alike: every pair of 0.8 or more is among the candidates."""
    rng = np.random.default_rng(6)
    draw = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    passage, sets = draw(60), []
    for _ in range(60):
        own = draw(int(rng.integers(5, 60)))
        sets.append(np.concatenate([passage, own]))
        sets.append(np.concatenate([passage, own[: len(own) - int(rng.integers(0, 5))], draw(int(rng.integers(0, 9)))]))
    rows = [(i, i, np.sort(x).tobytes()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "cls long, root long, shingles binary")
    want = {(i, j) for i in range(len(sets)) for j in range(i) if (o := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - o)}
    assert len(want) > 100
    for paired in (1, 8, 1000):
        assert want <= {(r.a, r.b) for r in nearcopies._across(df, 0.8, paired).collect()}


def test_one_of_each_keeps_one_of_repeated_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    twice = docs.union(docs)
    once = nearcopies.one_of_each(docs).collect()
    assert sorted(map(str, nearcopies.one_of_each(twice).collect())) == sorted(map(str, once)) and len(once) <= 50
    # one id, different texts: each is a document of its own
    mixed = spark.createDataFrame([(1, "a b c d e f g", "x"), (1, "h i j k l m n", "y"), (2, "a b c d e f g", "z"), (None, "a b c d e f g", "u"), (None, "o p q r s t u", "v"), (None, "o p q r s t u", "w")], "doc_id long, text string, component string")
    got = nearcopies.one_of_each(mixed).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "o p q r s t u"), (1, "a b c d e f g"), (1, "h i j k l m n")]


def test_closed_keys_make_no_rows(spark):
    """Keys whose classes are one component leave no row behind a join, and both forms keep the same rows."""
    now = spark.createDataFrame([(k, c, 0 if k else c % 2) for k in range(4) for c in range(50)], "at long, cls long, root long")
    open_ = now.groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("at", "n")
    kept = nearcopies._of_keys(now, open_.select("at"), open_)
    want = [(0, c, c % 2) for c in range(50)]
    assert sorted(map(tuple, kept.collect())) == want
    assert sorted(map(tuple, nearcopies._of_keys(now, open_.select("at"), open_, most=0).select("at", "cls", "root").collect())) == want
    assert "LeftOuter" not in kept._jdf.queryExecution().optimizedPlan().toString()
