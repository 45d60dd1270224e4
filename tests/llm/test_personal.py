"""Base spans against the patterns as given, the learned ones against made-up data in texts that were not learned from."""

import hashlib
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotloom.llm import boosting, personal, queries

SF = "/root/testdata/sf0.01"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    """Sorted (start, kind, end)."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.9@-+ (%)_0é2\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert [(s.start, s.kind, s.end) for s in personal.base_spans(text)] == plain(text)


@pytest.fixture(scope="module")
def texts():
    return [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t]


@pytest.fixture(scope="module")
def model(texts):
    rows = [personal.examples(t, 24) for t in texts[:400]]
    held = np.repeat(np.arange(len(rows)) % 3 == 0, [len(r[1]) for r in rows])
    return personal.fit(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), held)


def test_query_keeps_base_spans(spark):
    rows = {r.doc_id: r for r in queries.op13_personal_data(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(rows) == len(docs)
    for d in docs:
        want, r = plain(d["text"]), rows[d["doc_id"]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert {x for x in joined(want).split(",") if x} <= set(spans) and len(spans) == len(want) + r.n_added
        if not re.search(r"[0-9@]|\bat\b", d["text"] or ""):
            assert not spans
    assert sum(r.n_added for r in rows.values()) < 20  # the table's clean texts stay as they are


def test_made_up_data_is_found_and_look_alikes_are_left(texts, model):
    rng = np.random.default_rng(17)
    found = made = wrong = 0
    for t in texts[500:900]:
        t = re.sub("[0-9]", "", t[-160:]).replace("@", "")
        value, spans = personal._made(rng, t)
        got = {s for s, *_ in personal.find(f"{t} {value}. {t}", model)}
        made += len(spans)
        found += sum(personal.Span(s.kind, s.start + len(t) + 1, s.end + len(t) + 1) in got for s in spans)
        wrong += len(personal.find(f"{t} {personal._alike(rng, t)} {t}", model))
    assert found >= 0.95 * made and wrong <= 8


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to jane.doe (at) example (dot) com today", ["jane.doe (at) example (dot) com"]),
        ("call +1 (369) 555-1339 5927243074273351 now", ["+1 (369) 555-1339"]),
        ("two cards 4539578763621486 4539578763621486 here", ["4539578763621486", "4539578763621486"]),
        ("host 10[.]20[.]30[.]40 answered", ["10[.]20[.]30[.]40"]),
        ("on 2021-03-14 we counted 1,234,567 of 12.5 and 3.2.1", []),
        ("he was at home. Dot came by at noon", []),
        ("", []),
        (None, []),
    ],
)
def test_cases(model, text, want):
    got = [text[s.start : s.end] for s, *_ in personal.find(text, model)]
    assert [g for g in got if g in want] == want and len(got) <= len(want) + 1


def test_long_texts_take_linear_time(model):
    for piece in ("9", "9.", "1 ", "a", "a@", "a.", "+1", "(", "1-", "12 at dot "):
        began = time.time()
        personal.find(piece * (100_000 // len(piece)), model)
        assert time.time() - began < 60


def test_odd_rows_and_redaction(spark, model):
    rows = [(1, "mail a@b.co, ip 1.2.3.4", "x"), (1, "mail a@b.co, ip 1.2.3.4", "x"), (None, "+1 (369) 555-1339", "y"), (3, None, None), (4, "", "z"), (5, "é 😀 a@b.co", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumns({"base": F.lit(1), "kind": F.lit("k"), "score": F.lit(0.5), "n_ip": F.lit("n")})
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in personal.scan(df).collect())
    assert got == [("1", 1, 1, 0, 0, "email:5:11,ip:16:23")] * 2 + [("3", 0, 0, 0, 0, ""), ("4", 0, 0, 0, 0, ""), ("5", 1, 0, 0, 0, "email:4:10"), ("None", 0, 0, 0, 1, "phone:0:17")]
    hidden = {str(r.doc_id): r.redacted for r in personal.detect(df, model, redact=True).collect()}
    assert hidden == {"1": "mail [EMAIL], ip [IP]", "None": "[PHONE]", "3": None, "4": "", "5": "é 😀 [EMAIL]"}
    assert personal.scan(df.where("false")).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > -0.5)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    z = trees.margin(x[2000:])
    assert ((z > 0) == (y[2000:] > 0)).mean() > 0.97
    a, b = boosting.calibrate(z, y[2000:])
    assert abs(boosting.sigmoid(a * z + b).mean() - y[2000:].mean()) < 0.03
    assert np.isfinite(boosting.fit(np.zeros((0, 3)), np.zeros(0)).margin(np.zeros((2, 3)))).all()
