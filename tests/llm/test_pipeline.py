"""The pipeline's stages against plain versions of their decisions, and on odd input."""

import base64

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from slotloom.llm import langid, quality, queries

from tests.llm.test_llm import plain_containment
from tests.llm.test_nearcopies import components

SF = "/root/testdata/sf0.001"


def plain_quality(model, text, recorded):
    """The factorisation machine over all pairs of features, one text."""
    at, bucket, share, stats = quality.features([text], np.array([recorded], float))
    x = np.zeros(len(model.weight))
    x[bucket] = np.sqrt(share)
    x[quality.WORDS :] = model.dense(stats)[0]
    on = np.flatnonzero(x)
    v = model.factor[on] * x[on, None]
    gram = v @ v.T
    z = model.bias + model.weight @ x + (gram.sum() - np.trace(gram)) / 2
    return 1 / (1 + np.exp(-(model.slope * z + model.shift)))


def plain_language(model, text):
    """Mean of the scores of all n-grams, word by word."""
    import re

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    total, n = np.zeros(model.table.shape[1]), 0
    for w in words:
        stream = langid._stream([w])
        bucket, _ = langid.subwords(stream, np.array([0]), np.array([len(w)]))
        total, n = total + model.table[bucket].sum(0), n + len(bucket)
    if not n:
        return False
    z = (total / n + model.bias) * model.temperature
    p = np.exp(z - z.max())
    return (p / p.sum())[: len(model.langs)].max() >= model.reject_below


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
        if "quality" in name:
            model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), length_col="n_chars")
            want = [r.doc_id for r in before if plain_quality(model, r.text, r.n_chars) >= 0.7]
        elif "language" in name:
            model = langid.learn(docs)
            want = [r.doc_id for r in before if plain_language(model, r.text)]
        elif "simhash" in name:
            want = {c for _, c in components([(r.doc_id, r.text) for r in before])}
        else:
            items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            want = [r.doc_id for r in before if all(plain_containment(r.text, i.text) < 0.8 for i in items)]
        assert after == sorted(want)
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert len(corpus_pipeline.STAGES) == 5
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_run(spark):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len(rows) < len(docs) and set(rows) <= set(docs) and len(queries.QUERIES) == 10
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.n_tokens == len(enc.encode_ordinary(docs[d].text)) for d, r in rows.items())
    texts = [docs[d].text for d in rows]
    assert len(set(texts)) == len(texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [labels[d] for d in rows if d in labels]
    assert np.mean(known) > 0.95  # what stays is good, as far as it is labelled
    good = [d for d, q in labels.items() if q == 1 and langid.zlib.crc32(str(d).encode()) % 4 != 2]
    assert len(good) > 20


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_columns(spark, name, stage):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns named like what stages make."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, " \n ", None, None, None), (9003, "word " * 60000, "en", "s", 300000), (None, "a text without an id", "en", "s", 20)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs = docs.union(docs.limit(5))
    own = ("__id", "__of", "__hash", "predicted", "quality_score", "__text", "score", "accepted", "lang_pred", "component_id", "id", "hash", "times", "text2", "row", "hits", "fp")
    extra = docs.withColumns({c: F.lit("x") for c in own})
    got = stage(spark, extra, SF)
    n = extra.count()
    rows = got.collect()
    assert len(rows) <= n and ("bpe" not in name or len(rows) == n)
    if "bpe" not in name:
        assert got.columns == extra.columns and rows and all(r[c] == "x" for r in rows for c in own)
        assert stage(spark, extra.where("false"), SF).count() == 0
    if "simhash" in name:
        keys = [(r.doc_id, r.text) for r in rows]
        assert len(set(keys)) == len(keys)
        assert sum(not (r.text or "").strip() for r in rows) == 1
    if "decontamination" in name:
        assert sum(r.doc_id is None for r in rows) >= 2
