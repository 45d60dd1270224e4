"""Each operator against a brute-force version, a library or a round trip, and on nulls, empty and long texts, repeats,
empty tables and clashing columns."""

import base64
import hashlib
import html
import math
import re
import xml.etree.ElementTree as ET
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotloom.llm import bpe, chat, decontam, graph, htmltext, langid, licenses, quality, queries, simhash, store, tokenfile, topk
from slotloom.llm.store import fresh_path

SF = "/root/testdata/sf0.001"
RANKS, VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "it's we're I'll 'd ' s x'sfoo ''s", "  two  spaces \n\n end  ", "é日本 ñ٣Ⅷ² 😀_", "<|endoftext|> x", "ab " * 3000, "a" * 3000, "a", "a"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Odd texts, repeated rows, a null id, and extra columns named like the operators' own."""
    rows = [(i, t, "en", "s", 0, 1.0, "k") for i, t in enumerate(ODD)] + [(0, None, None, None, 0, None, None), (None, "null id text", "en", "s", 1, 1.0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double, fp string")


@pytest.fixture(scope="module")
def none(odd_docs):
    return odd_docs.where("false")


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_topk(vectors, asked, k):
    """(query, rank, id, score) over all rows; a query id is asked with its least vector."""
    floors = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    queries_ = {}
    for i, v in floors:
        if asked(i):
            queries_[i, len(v)] = min(queries_.get((i, len(v)), v), v)
    out = []
    for (i, n), q in queries_.items():
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in floors if j != i and len(v) == n)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 64]) for i in range(300)] + [(5, [0.0] * 6), (5, [0.25] * 6), (20, [0.0] * 6), (900, None), (901, [0.1, None] * 3), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [0.5, 0.5]), (905, []), (None, [0.1] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "dim": F.lit(2), "block": F.lit(3), "score": F.lit(4)})
    for block in (64, 8192):
        got = topk.search(df, df.where("vec_id % 20 = 0"), k=7, block=block, batch=8).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_topk(vectors, lambda i: i % 20 == 0, 7)
    assert topk.search(df.where("false"), df.where("false")).count() == 0
    assert topk.search(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_topk_of_huge_values(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.integers(-(2**24), 2**24, 5)]) for i in range(90)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = topk.search(df, df.where("vec_id % 10 = 0"), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_topk(vectors, lambda i: i % 10 == 0, 5)
    over = spark.createDataFrame([(i, [x] * 4) for i, x in enumerate([1e25, 2e25, -1e25])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in topk.search(over, over.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]


def test_nra_equals_full_scores():
    rng = np.random.default_rng(2)
    for scale in (2, 40, 5000, 2**28):
        x, q = np.floor(rng.normal(0, scale, (500, 16))), np.floor(rng.normal(0, scale, (20, 16)))
        own = np.zeros((20, 500), bool)
        own[np.arange(5), np.arange(5)] = True
        full = np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for r in x] for s in q], object)
        full[own] = -(10**30)
        found = list(topk.nra(x, q, 10, own))
        assert sorted(i for i, *_ in found) == list(range(20))
        for i, rows, score in found:
            floor = sorted(full[i])[-10]
            assert {j for j in range(500) if full[i][j] >= floor} <= set(rows.tolist()) and [int(s) for s in score] == [full[i][j] for j in rows]


def test_nra_reads_no_further_than_needed():
    """A few heavy rows are found near the heads of the lists; rows without a difference are read to the end."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.pareto(1.0, (4000, 16)) * 3)
    tell = topk.Reading()
    list(topk.nra(x, np.abs(x[:32]) + 1, 10, np.zeros((32, 4000), bool), tell))
    assert len(tell.share) == 32 and max(tell.share) <= 1 / 8 and max(tell.resolved) <= 20
    tell = topk.Reading()
    list(topk.nra(np.ones((4000, 16)), np.ones((1, 16)), 10, np.zeros((1, 4000), bool), tell))
    assert tell.share == [1.0] and tell.resolved == [4000]


def test_html(spark):
    page = "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class='content'><h1>Title &amp; more</h1><p>First   para is long enough to be text.<br>goes on</p><p>Second <a href=y>link</a> para.</p><ul><li>one<li>two</ul></div><div id=comments><p>A very long and friendly reader comment that goes on.</p></div><aside>side</aside><form>name</form><script>x<y</script><footer>&copy;</footer>"
    assert htmltext.extract(page) == "Title & more\n\nFirst para is long enough to be text. goes on\n\nSecond link para.\n\none\n\ntwo"
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<div>") == ""
    assert htmltext.extract("bare &lt; text") == "bare < text"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert htmltext.extract(deep) == "deep"
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op2_html_extraction(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in htmltext.main_text(odd).collect()) == [("", 0), ("", 0), ("a", 1)]


def plain_density(page):
    """(density, sum) of each block element of a small well-formed page, by tag and order, straight from the formula."""
    root = ET.fromstring(page)
    text = lambda e: "".join(e.itertext())
    own = lambda e: sum(len(" ".join(t.split())) for x in e.iter() for t in [x.text or "", *(c.tail or "" for c in x)])
    body_links, body_chars = sum(own(a) for a in root.iter("a")), own(root)

    def density(e):
        c, t = own(e), max(1, len(list(e.iter())) - 1)
        if not c:
            return 0.0
        links = [a for a in e.iter("a") if a is not e]
        lc, lt = max(1, sum(own(a) for a in links)), max(1, len(links))
        base = math.log(c * lc / max(1, c - sum(own(a) for a in links)) + body_links / max(1, body_chars) * c + math.e)
        return c / t * math.log(c * t / (lc * lt)) / math.log(base) if c * t > lc * lt else 0.0

    assert text(root)
    return [(e.tag, density(e), sum(density(k) for k in e if k.tag != "a")) for e in root.iter() if e.tag in ("body", "div", "p", "ul", "li", "h1")]


def test_densities_against_the_formula():
    page = "<body><div><ul><li><a>one</a></li><li><a>two words</a></li></ul></div><div><h1>A title</h1><p>Some text that is long, with <a>a link</a> in it.</p><div><p>More and more text.</p><p>End</p></div></div><p>last</p></body>"
    body = htmltext.parse(page)
    htmltext.measure(body)
    got, stack = [], [body]
    while stack:
        x = stack.pop()
        got.append((x.tag, x.density, x.sum))
        stack += reversed(htmltext.children(x))
    want = plain_density(page)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want])


def test_html_by_density_alone(spark):
    """Without article elements and telling names, articles of some length come out just the same."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    some = 0
    for r in rows:
        want = htmltext.extract(r.html)
        plain = r.html.replace("article>", "div>")
        assert htmltext.extract(plain) == want
        if len(want) >= 300:
            some += 1
            assert htmltext.extract(plain.replace(' class="ad"', "")) == want
    assert some > 150
    wrapped = "<body><div class='banner'><p>" + "All the text of the page. " * 20 + "</p></div></body>"
    assert htmltext.extract(wrapped) == ("All the text of the page. " * 20).strip()
    assert htmltext.extract("<body><div><p>aa</p><p>bb</p></div><div><p>aa</p><p>bb</p></div></body>") == "aa\n\nbb\n\naa\n\nbb"


def paras(n, text="Some words of a paragraph that goes on for a while, with sense. "):
    return "".join(f"<p>{i} {text * 2}</p>" for i in range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_html_short_section_beside_a_long_one(n):
    page = f"<body><nav>menu</nav><section>{paras(12)}</section><section>{paras(n)}</section><footer>x</footer>"
    assert len(htmltext.extract(page).split("\n\n")) == 12 + n


def test_html_parts_beside_the_densest_node():
    titled = htmltext.extract(f"<body><article><header><h1>Real title</h1></header><div>{paras(12)}</div></article>")
    assert titled.startswith("Real title\n\n0 Some") and len(titled.split("\n\n")) == 13
    lead = htmltext.extract(f"<body><h1>Title</h1><p>Lead.</p><section>{paras(3)}</section><section>{paras(5)}</section>")
    assert lead.startswith("Title\n\nLead.\n\n0 Some") and len(lead.split("\n\n")) == 10
    links = "<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>"
    assert htmltext.extract(f"<body>{links}<div>{paras(4)}</div><div>{links}</div>") == htmltext.extract(f"<body>{paras(4)}")


@pytest.mark.parametrize("name", ['id="discussion-of-results"', 'class="share-price-report"', 'class="comment-free notice-board-article"'])
def test_html_names_with_other_words(name):
    page = f"<body><div {name}>{paras(8)}</div><div>Other stuff in the page, short.</div>"
    assert htmltext.extract(page) == htmltext.extract(f"<body>{paras(8)}")
    comments = f"<body><div>{paras(2)}</div><div class='reader-comments'>{paras(9)}</div><div id='cookie-banner'><p>We use cookies.</p></div>"
    assert htmltext.extract(comments) == htmltext.extract(f"<body>{paras(2)}")


def test_html_wrapped_in_other_ways():
    """However an article is cut into elements, its text is the same."""
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        want, body = htmltext.extract(page), re.search(r"<article>(.*?)</article>", page, re.S)[1]
        title, ends = body.find("</h1>") + 5, [m.end() for m in re.finditer("</p>", body)]
        first, late = (ends[0], ends[len(ends) * 3 // 4]) if ends else (title, title)
        assert htmltext.extract(page.replace(body, f"<div>{body[:first]}</div><div>{body[first:]}</div>")) == want
        assert htmltext.extract(page.replace(body, f"<header>{body[:title]}</header><div>{body[title:]}</div>")) == want
        assert htmltext.extract(page.replace(body, f"<section>{body[:late]}</section><section>{body[late:]}</section>")) == want


def test_html_quotes():
    assert htmltext.extract(f'<body><p>a</p><img src="data:{"x" * 9000}>"><p>b</p>') == "a\n\nb"
    assert htmltext.extract("<body><p title=it's>a</p><p>b</p>") == "a\n\nb"
    for broken in ("<p " * 50000, "<p '" * 50000, "<a <a \"'" * 30000, "<p title=\"a' " * 30000):
        assert htmltext.extract(broken) is not None


def test_html_long_and_broken(spark):
    assert htmltext.extract('<p title="' * 20000 + "x") is not None
    long = "<body>" + "<p>word and word</p>" * 50000 + "</body>"
    assert htmltext.extract(long).count("word and word") == 50000
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.main_text(none).count() == 0


def test_language_held_out(spark):
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 200 < len(held) < 300
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_odd_rows(odd_docs, none):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == len(ODD) + 2
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 3)) for r in rows if r.doc_id is not None)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_rejects_what_it_has_not_learned(spark):
    model = langid.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert model.outside_rejected > 0.95 and 0 < model.reject_below <= 0.5
    outside = ["\u0412\u0441\u0435 \u0441\u0447\u0430\u0441\u0442\u043b\u0438\u0432\u044b\u0435 \u0441\u0435\u043c\u044c\u0438 \u043f\u043e\u0445\u043e\u0436\u0438 \u0434\u0440\u0443\u0433 \u043d\u0430 \u0434\u0440\u0443\u0433\u0430", "aaaa bbbb cccc", "for (int i = 0; i < n; ++i) { sum += a[i] * b[i]; } return sum;", "xkcd qwrt zzxv bnmp lkjh gfds", "\u543e\u8f29\u306f\u732b\u3067\u3042\u308b"]
    df = spark.createDataFrame(list(enumerate(outside)), "doc_id long, text string")
    assert not any(r.accepted for r in langid.predict(df, model).collect())


def test_many_languages(spark):
    """More than 64 languages are all learned."""
    rng = np.random.default_rng(0)
    alphabets = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5, replace=False)) for _ in range(70)]
    rows = [(i * 6 + j, " ".join("".join(rng.choice(list(x), 6)) for _ in range(30)), f"l{i:02d}") for i, x in enumerate(alphabets) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(df).langs) == 70


def test_one_id_brings_no_more_rows(spark):
    rows = [(1, "the same text said again", "en", 1)] * 3000 + [(i, f"another text number {i} of some words", "en", i % 2) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    assert 0 <= quality.predict(df, quality.train(df)).first().quality_score <= 1 and langid.train(df).langs == ["en"]


def test_calibration_is_bounded():
    rng = np.random.default_rng(0)
    y = (np.arange(60) % 3 > 0).astype(float)
    for z in (np.where(y == 1, 20.0, -20.0), np.where(y == 1, 1e-3, -1e-3), rng.normal(0, 5, 60), np.zeros(60), np.where(y == 1, -5.0, 5.0)):
        slope, shift = quality.calibrate(z, y)
        assert slope > 0 and np.abs(slope * z + shift).max() < 50
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        assert np.isfinite(p).all() and (p > 0).all() and (p < 1).all()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_quality_scores_are_not_saturated(spark, sf):
    where = f"/root/testdata/sf{sf}"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = quality.learn(docs, labels, length_col="n_chars")
    assert 0.1 < model.slope < 5
    rows = quality.predict(docs, model, length_col="n_chars").join(labels, "doc_id").where(langid.held_out()).collect()
    good, bad = np.array([r.quality_score for r in rows if r.quality == 1]), np.array([r.quality_score for r in rows if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.9 and len({r.quality_score for r in rows}) > 0.8 * len(rows)


def test_quality_of_another_column(spark):
    df = spark.createDataFrame([(i, f"some text {i}", 5, "x") for i in range(20)], "key long, body string, predicted int, quality_score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "key long, quality int")
    assert quality.classify(df, labels, id_col="key", text_col="body").count() == 20


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_odd_rows(spark, odd_docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(odd_docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_factorisation_identity():
    """The sum-of-squares score equals all pairwise products."""
    rng = np.random.default_rng(0)
    width = len(quality.STATS) + len(quality.META)
    size = quality.WORDS + width * (1 + quality.CLASSES)
    z = np.zeros(width)
    m = quality.Model(0.3, rng.normal(0, 1, size), rng.normal(0, 0.1, (size, 3)), z, z + 1, np.zeros((width, quality.CLASSES - 1)), 1.0, 0.0)
    text, bucket, share, stats = quality.features(["one two two three"])
    x = np.zeros(size)
    x[bucket] = np.sqrt(share)
    x[quality.WORDS :] = m.dense(stats)[0]
    on = np.flatnonzero(x)
    pairs = sum(m.factor[i] @ m.factor[j] * x[i] * x[j] for k, i in enumerate(on) for j in on[k + 1 :])
    assert np.isclose(m.score(["one two two three"])[0], 1 / (1 + np.exp(-(0.3 + m.weight @ x + pairs))))


def plain_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest id of each row's component; fps: list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (f"{plain_fingerprint(t):016x}", None) for d, t in docs}
    comp = plain_components([(d, plain_fingerprint(t)) for d, t in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_dedup(spark, SF).collect()}
    assert got == {d: (want[d][0], c) for (d, _), c in zip(docs, comp)}


def test_simhash_odd_rows(odd_docs, none):
    rows = simhash.near_duplicates(odd_docs).collect()
    fps = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    assert len(rows) == len(ODD) + 2 and [r.component_id for r in rows] == plain_components(fps)
    assert {r.fingerprint for r in rows if r.doc_id in (0, 1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(none).count() == 0


def test_links_in_crowded_blocks(spark):
    rng = np.random.default_rng(3)
    base = [int(rng.integers(1 << 62)) for _ in range(3)]
    fps = set()
    for b in base:
        for _ in range(80):
            x = b
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    root = {r.node: r.root for r in graph.components(simhash.links(df, paired=8)).collect()}
    mine = [root.get(s, s) for (s,) in signed]
    want = plain_components(list(enumerate(fps)))
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(edges.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aabbeest 'sdmtrlv \n\t12.,!é日　ñ²😀_")), max_size=60))
def test_bpe_equals_library(text):
    (_, _, ids, _) = next(bpe.encoder(RANKS)([text]))
    assert ids.tolist() == tik().encode_ordinary(text)
    assert bpe.ranks(RANKS).decode(ids) == text.encode()


def test_bpe_of_a_vocabulary_over_16_bits(tmp_path):
    tokens = [bytes([i]) for i in range(256)] + [bytes([i, j]) for i in range(256) for j in range(256)]
    assert len(tokens) > 1 << 16
    at = tokens.index(b"zz")
    tokens.append(tokens.pop(at))
    (tmp_path / "wide.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    table = bpe.Ranks(str(tmp_path / "wide.tiktoken"))
    ((_, _, ids, _),) = bpe.Encoder(table.replay, len(table.length))(["zz"])
    assert ids.tolist() == [len(tokens) - 1] and table.decode(ids) == b"zz"


def test_bpe_of_a_very_long_word():
    enc, table = tik(), bpe.ranks(RANKS)
    for word in ("ab" * 4000, "x" * 5001, "".join(chr(97 + i * i % 26) for i in range(9000))):
        assert table.alone(word.encode()) == enc.encode_ordinary(word)


def test_bpe_rows(odd_docs, none):
    enc = tik()
    rows = bpe.encode_decode(odd_docs, RANKS, with_ids=True).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        t = "null id text" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_decode(none, RANKS).count() == 0


def test_token_files(spark, odd_docs, none):
    tokenizer = Tokenizer.from_file(VOCAB)
    docs = odd_docs.where("doc_id IS NOT NULL").orderBy("doc_id", "text").select("doc_id", "text").collect()
    want, start = [], 0
    for r in sorted(docs, key=lambda r: (r.doc_id, r.text or "")):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    shards = tokenfile.write_token_files(odd_docs.where("doc_id IS NOT NULL"), fresh_path(spark, "t"), VOCAB, 2, length=16, rows=4, shards=3)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_index(shards).collect()]
    assert sorted(got) == sorted(want)
    ids, mask, starts, names = next(tokenfile.sequences(shards.where("n_ids > 100").first().path))
    assert ids.shape[1] == 16 and not ids.flags.owndata and mask[0].all() and starts.sum() == len(names)
    assert tokenfile.token_index(tokenfile.write_token_files(none, fresh_path(spark, "t"), VOCAB, 2)).count() == 0
    assert tokenfile.token_index(tokenfile.write_token_files(odd_docs, fresh_path(spark, "t"), VOCAB, 2)).count() == len(ODD) + 2


def test_token_files_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenizer, want, start = Tokenizer.from_file(VOCAB), [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, SF).collect()) == want


def test_token_files_of_another_kind_of_vocabulary(spark, odd_docs):
    path = public_tokenizers.path("word_bpe_49k.json")  # lower-cases, drops white space
    tokenizer = Tokenizer.from_file(path)
    docs = odd_docs.where("doc_id IS NOT NULL")
    got = sorted((r.doc_id, r.n_tokens) for r in tokenfile.token_index(tokenfile.write_token_files(docs, fresh_path(spark, "t"), path, 2)).collect())
    assert got == sorted((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())


def test_own_folder_only_in_one_process():
    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="none"))

    assert store.shared_dir(session("local[4]")).startswith("file:")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(session(master))


def test_join_of_hot_keys(spark):
    many = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(900)], "k long, i long")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k long, v string")
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    for parts in (1, 4, 1000):
        got = store.join_unique(many, one, "k", counts, 900, parts).collect()
        assert sorted((r.k, r.i, r.v) for r in got) == sorted((r.k, r.i, f"v{r.k}") for r in many.collect() if r.k < 6)


def plain_containment(doc, item, width=5):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    a, b = words(doc), words(item)
    k = min(width, len(b))
    if not k:
        return 0.0
    have = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
    want = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    return len(have & want) / len(want)


def test_decontamination_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    d, b = docs.collect(), items.collect()
    long = [(10_000 + i, " ".join([d[i].text, b[i % len(b)].text.upper().replace(" ", "\n", 3), d[i + 1].text])) for i in range(5)]
    part = [(20_000, b[0].text[: int(len(b[0].text) * 0.9)]), (20_001, b[0].text[: len(b[0].text) // 2]), (20_002, None), (20_003, ""), (20_004, b[1].text), (20_004, b[1].text)]
    extra = spark.createDataFrame(long + part, "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(extra).withColumn("item", F.lit(0)).withColumn("shared", F.lit(0))
    more = items.union(spark.createDataFrame([(900, None), (901, ""), (902, "..."), (903, "zz yy")], items.schema))
    got = sorted((r.doc_id, r.item_id) for r in decontam.search(whole, more).collect())
    want = sorted((r.doc_id, i.item_id) for r in whole.collect() for i in more.collect() if plain_containment(r.text, i.text) >= 0.8)
    assert got == want and len(got) > 5
    clean = decontam.decontaminate(whole, more)
    hit = {w[0] for w in want}
    assert clean.columns == whole.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in whole.collect() if r.doc_id not in hit)
    assert decontam.search(whole, items.where("false")).count() == 0 and decontam.search(whole.where("false"), items).count() == 0


def test_licenses(spark, none):
    mit = licenses.TEMPLATES["MIT/text"]
    texts = [
        "Released under the MIT License.", "x x x x\nreleased UNDER the mit license!\ny", "Licensed under CC BY-NC 4.0", "This is no license at all", None, "", "one", "Released under\nthe MIT License.",
        "before " * 50 + mit.replace(" ", "\n * ", 40) + " after" * 50, "Inside a line, released under the MIT license, and on it goes for a while.", "a " * 20000 + mit[: int(len(mit) * 0.95)] + " b" * 20000,
        mit[: len(mit) // 2], licenses.TEMPLATES["BSD-3-Clause/text"], licenses.TEMPLATES["LGPL-3.0"] + " and also: " + licenses.TEMPLATES["GPL-3.0"],
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (0, texts[0], "x", 1)], "doc_id long, text string, license string, row int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.license, r.start) for r in licenses.scan(docs).collect())
    # half the MIT text still holds its grant whole
    assert got == [(-1, "MIT", 1), (0, "MIT", 1), (0, "MIT", 1), (1, "MIT", 5), (2, "CC-BY-NC-4.0", 1), (7, "MIT", 1), (8, "MIT/text", 51), (9, "MIT", 4), (10, "MIT/text", 20001), (11, "MIT/grant", 1), (12, "BSD-3-Clause/text", 1), (13, "GPL-3.0", 16), (13, "LGPL-3.0", 1)]
    assert licenses.scan(none).count() == 0


PIECES = st.lists(st.sampled_from(["a", "b", ":", ": ", "#", "##", "\\", " ", "\n", "### ", "</turn>", " </turn>\n", "\\###", "### Assistant: "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat.locate(turns)
    assert chat.parse(text) == turns and all(ok for *_, ok in spans)
    assert "".join(text[a:b] for a, b, _ in spans) == text
    for (role, own), (a, b, _) in zip(turns, spans):
        lo, hi = chat.text_span(text[a:b], role, own)
        assert chat.unescape(text[a:b][lo:hi]) == own


def test_chat_detects_rewriting():
    def forgetful(turns):
        return "|".join(("..." if i < len(turns) - 1 and r == "assistant" else t) for i, (r, t) in enumerate(turns))

    assert [ok for *_, ok in chat.locate([("user", "a"), ("assistant", "b"), ("user", "c")], forgetful)[1]] == [True, False, False]


def test_chat_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### x </turn> y"), (1, 1, "assistant", "### x </turn> y"), (2, None, None, None), (None, 0, "assistant", "lost"), (3, 0, "user", "only")] + [(4, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(100)]
    turns = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, chunk int, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert len(got) == 5
    for c in (1, 2, 3, 4, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_chats(turns.where("false"))).count() == 0
