"""Signs between words, sentence ends at slots, and where phrases and contexts stand."""

import random
import unicodedata

import duckdb
from pyspark.sql import functions as F

from slotloom.functions import text as T
from slotloom.operators import align, metrics, provenance, review, rules, scored, slots
from slotloom.plans import catalog

RULES = "rule_id string, ord long, tier string, candidates array<string>, conditions array<struct<off:int,tok:string>>, anchor_off int, anchor_tok string"


def test_signs_between_words(spark):
    texts = ["so, [__] the end", "so. [__] the end", "so [__], the end", "so [__] The end", "go to [__] The end", "what the [__] I the", "[__] the", '"[__] the', "a\nso\t[__]\nthe", "so [__]! The", "so [__] >> the"]
    found = slots.slot_features(spark.createDataFrame(list(enumerate(texts)), "track_id long, text string"), 1, 1)
    table = [("so", 1, "low", ["x"], [(-1, "so")], -1, "so"), ("the", 2, "low", ["x"], [(1, "the")], 1, "the"), ("bos", 3, "low", ["x"], [(-1, "<BOS>"), (1, "the")], 1, "the")]
    got = lambda t: {(r.track_id, r.rule_id) for r in rules.candidate_matches(found, spark.createDataFrame(t, RULES)).collect()}
    assert got(table) == {(0, "so"), (0, "the"), (1, "the"), (2, "so"), (3, "so"), (4, "the"), (6, "the"), (6, "bos"), (7, "the"), (8, "so"), (8, "the"), (9, "so"), (10, "so")}
    # An exact rule that spans the slot takes the sentence's end away.
    assert got([*table, ("exact", 0, "exact", ["y"], [(-1, "so"), (1, "the")], 1, "the")]) >= {(3, "exact"), (3, "the")}


def test_sentence_ends(spark):
    cases = [("a ", " Then we", True), ("go to ", " Paris now", False), ("what the ", " I saw", False), ("a ", ". Then", False), ("a ", " Lord what", False), ("out of the ", " Then", False), ("a ", " then", False), ("a ", " >> then", True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b string, a string, want boolean")
    assert [r.i for r in rows.where(T.virtual_break("b", "a", ["out of the"], ["lord"]) != F.col("want")).collect()] == []
    said = rows.select("i", T.format_punct(F.lit("w"), "b", "a", ["out of the"], ["lord"]).alias("w")).orderBy("i").collect()
    assert [r.w for r in said] == ["w.", "w.", "w", "w.", "w", "w", "w", "w."]


def test_phrases_of_any_length_guard(spark, monkeypatch):
    """A phrase of four words keeps a sentence open at a slot, by a join and by a list; then a rule reaches over it."""
    texts = ["I have never been to [__] Home", "He said never been to [__] Home", "I have never,been to [__] Home", "they have\u00a0Never  been to [__] Home", "have never been to. [__] Home", "only [__] Home", "[__] Home", "i don’t know [__] Home"]
    tracks = spark.createDataFrame(list(enumerate(texts)), "track_id long, text string")
    phrases = ["have never been to", "we have never been to", "don't know", " ", "Only"]
    want = [False, True, True, False, True, False, True, False]
    marked = slots.slot_features(tracks, 1, 1, lead=4)
    paths = slots.phrase_paths(spark.createDataFrame([(p,) for p in phrases + ["only"]], "phrase string"))
    assert sorted(map(tuple, paths.collect())) == [("know don't", 2), ("only", 1), ("to been never have", 4)]
    assert [r.breaks for r in marked.orderBy("track_id").collect()] == [True] * 8
    for most in (slots.PHRASES, 0):
        monkeypatch.setattr(slots, "PHRASES", most)
        kept = slots.continues(marked, paths)
        assert kept.columns == marked.columns and [r.breaks for r in kept.orderBy("track_id").collect()] == want
    assert [r.breaks for r in slots.slot_features(tracks, 1, 1, continuing=[p for p in phrases if p.strip()]).orderBy("track_id").collect()] == want
    assert slots.continues(marked, paths.where("false")).where("breaks").count() == 8
    rule = spark.createDataFrame([("r", [(1, "home")], 1, "home", ["x"], "low", 1)], "rule_id string, conditions array<struct<off int, tok string>>, anchor_off int, anchor_tok string, candidates array<string>, tier string, ord long")
    assert sorted(r.track_id for r in rules.candidate_matches(slots.continues(marked, paths), rule).collect()) == [i for i, b in enumerate(want) if not b]


def test_overlapping_spans_against_a_plain_loop(spark):
    """Random spans, repeated rows, and chains in which every match waits for the one before; one of 10^5 matches."""
    rng, rows = random.Random(4), []
    for track in range(30):
        rows += [(track, rng.randrange(40), rng.randrange(1, 4), f"r{rng.randrange(9)}", rng.randrange(30)) for _ in range(rng.randrange(40))]
    rows += rows[:20] + [(100, i, 2, "r", i) for i in range(60)] + [(101, i, 2, "r", -i) for i in range(60)]
    want = []
    for track in {r[0] for r in rows}:
        taken = set()
        for ord_, rule, at, span in sorted({(o, r, a, s) for t, a, s, r, o in rows if t == track}):
            if taken.isdisjoint(range(at, at + span)):
                taken |= set(range(at, at + span))
                want.append((track, at, span, rule, ord_))
    schema = "track_id long, token_index int, span int, rule_id string, ord long"
    assert sorted(map(tuple, rules.resolve_overlaps(spark.createDataFrame(rows, schema)).collect())) == sorted(want)
    long_ = spark.range(100_000).select(F.lit(1).cast("long").alias("track_id"), F.col("id").cast("int").alias("token_index"), F.lit(2).alias("span"), F.lit("r").alias("rule_id"), F.col("id").alias("ord"))
    assert rules.resolve_overlaps(long_).agg(F.count("*"), F.sum(F.col("token_index") % 2)).first()[:] == (50_000, 0)
    assert rules.resolve_overlaps(long_.where("false")).count() == 0


def test_classes_in_templates(spark):
    """Many templates in one call: a class holds one of its words, next to literals, edges, wildcards and other classes."""
    texts = ["we saw [__] in town", "we saw [__] on town", "they saw [__] in town", "go [__] in", "[__] in town", "saw, [__] in-town", "ran [__] far", "ran [__] x in", "saw [__]. In town"]
    found = slots.slot_features(spark.createDataFrame(list(enumerate(texts)), "track_id long, text string"), 2, 2)
    table = ["<verb> [this|that] <place>", "we <verb> [this|that] in", "^ [this|that] <place>", "<verb> [this|that] * <place>", "ran [this|that] far", "<nothing> [this|that] far"]
    words = spark.createDataFrame([("saw", "verb"), ("ran", "verb"), ("ran", "move"), ("in", "place"), ("on", "place"), ("saw", "verb")], "tok string, cls string")
    compiled = rules.compile_rules(spark.createDataFrame([(t,) for t in table], "template string")).withColumn("rule_id", F.col("template"))
    assert [r.rule_id for r in rules.unknown_classes(compiled, words).collect()] == ["<nothing> [this|that] far"]
    counts = spark.createDataFrame([(-1, "saw", 5), (1, "in", 4), (1, "far", 1), (-2, "we", 2)], "off int, tok string, n int")
    anchored = rules.with_anchor(compiled, counts, words)
    assert {r.rule_id: (r.anchor_off, r.anchor_tok) for r in anchored.collect()}["<verb> [this|that] <place>"] == (1, "<place>")
    got = {(r.track_id, r.rule_id) for r in rules.candidate_matches(found, anchored, words).collect()}
    # Words are the tokens: the first one of in-town is a place.
    assert got == {(0, table[0]), (1, table[0]), (2, table[0]), (5, table[0]), (0, table[1]), (4, table[2]), (7, table[3]), (6, table[4])}


def test_patterns_need_their_signs(spark):
    contexts = spark.createDataFrame([("so, [ __ ] the end",), ("so. [__] the",), ("also [__] the",), ("so [__] there",), ("so x [__] the",), (None,)], "context string")
    assert [r.matched for r in rules.pattern_match(contexts, "so [this|that] the").collect()] == [True, False, False, False, False, False]
    assert [r.matched for r in rules.pattern_match(contexts, "so * [] the").collect()] == [False, False, False, False, True, False]


def test_contexts(spark):
    events = spark.createDataFrame([(1, 0, 0, 9, "a [__]"), (1, 1, 9, 9, "[__] b [__]"), (1, 2, 18, 9, " ")], "track_id long, event_index int, start_ms long, dur_ms long, text string")
    fills = spark.createDataFrame([(1, 0, "x"), (1, 2, None)], "track_id long, token_index int, word string")
    rows = slots.filled_context(slots.extract_slots(events), events, fills).orderBy("token_index").collect()
    assert [r.context for r in rows] == ["a [__]", "a x [__] b …", "a x … b [__]"]
    far = spark.createDataFrame([(1, "Aaaaaaaaaaaaaaaaaa [__] bbbbbbbbbbbbbbbbbbbbb now.")], "track_id long, text string")
    assert [(r.context, r.fallback) for r in slots.sentence_context(far, words=1, most=12).collect()] == [("aaa [__] bbb", True)]
    pages = spark.createDataFrame([(1, "One. <b>[ __ ]</b>! [music] >> x[__] go [__]. Now")], "k int, text string")
    got = [(r.token_index, [tuple(f) for f in r.features]) for r in slots.discovery_features(pages, 1, 1).orderBy("token_index").collect()]
    assert got == [(0, [(-1, "one.", True), (1, "!", True)]), (2, [(-1, "go", False), (1, ".", True)])]


def test_phrases_are_located(spark):
    kind = "array<struct<word:string,token_index:int,resolved:string>>"
    word = lambda *ws: [(w, None, None) if isinstance(w, str) else ("[__]", *w) for w in ws]
    timeline = spark.createDataFrame([(1, 0, 0.0, 4.0, word("so", (0, None), "it")), (1, 1, 4.0, 8.0, word("go", (1, "that"), "now", (2, None))), (1, 2, 60.0, 64.0, word("so", (3, None), "it"))], f"track_id long, event_index int, start_s double, end_s double, words {kind}")
    asked = [("a", ["so", "[__]", "it"], 1.0), ("b", ["go", "that", "now", "[__]"], 1.0), ("c", ["so", "[__]", "it"], 62.0), ("d", ["so", "[__]", "it"], 30.0), ("e", ["[__]"], 1.0), ("f", ["go", "this", "now", "[__]"], 1.0)]
    phrases = spark.createDataFrame([(i, 1, w, t) for i, w, t in asked], "phrase_id string, track_id long, words array<string>, at_s double")
    assert {(r.phrase_id, tuple(r.token_indexes)) for r in align.locate_phrase(phrases, timeline).collect()} == {("a", (0,)), ("b", (2,)), ("c", (3,))}


def located(phrases, timeline, events, reach):
    """Phrases (id, track, words, playhead) in events (track, index, start, end, words), by trying every start."""
    out = set()
    for name, track, words, at in phrases:
        own = sorted((e for e in timeline if e[0] == track), key=lambda e: (e[2], e[1]))
        near = [(max(e[2] - at, at - e[3], 0.0), k) for k, e in enumerate(own) if e[3] >= at - reach and e[2] <= at + reach]
        line = [t for _, k in sorted(near, key=lambda x: x[1]) if abs(k - min(near)[1]) <= events for t in own[k][4] or []]
        maps = set()
        for s in range(len(line) - len(words) + 1):
            pairs = list(zip(words, line[s:]))
            if all(t[0] == w or t[0] == "[__]" and t[2] == w for w, t in pairs) and any(t[0] == w != "[__]" for w, t in pairs):
                maps.add(tuple(t[1] for w, t in pairs if w == t[0] == "[__]" and t[1] is not None))
        if len(maps - {()}) == 1:
            out.add((name, *(maps - {()})))
    return out


def test_phrases_over_several_events_are_those_of_brute_force(spark):
    """Phrases longer than an event, events without words, of no time or over others, a phrase twice in its table."""
    r = random.Random(7)
    slot = lambda k: ("[__]", r.choice([k, k, None]), r.choice([None, "a", "b"]))
    word = lambda k: slot(k) if r.random() < 0.3 else (r.choice("ab"), None, None)
    timeline = [(t, i, at := float(r.randrange(0, 80)), at + r.choice([0, 2, 40]), r.choice([None, [], *[[word(100 * i + k) for k in range(n)] for n in (1, 2, 3, 9)]])) for t in range(6) for i in range(14)]
    asked = [(f"p{k}", r.randrange(6), [r.choice(["a", "b", "[__]"]) for _ in range(r.randrange(1, 8))], float(r.randrange(-20, 100))) for k in range(1500)]
    asked = [p for p in asked if "[__]" in p[2]]
    events = spark.createDataFrame(timeline, "track_id long, event_index int, start_s double, end_s double, words array<struct<word:string,token_index:int,resolved:string>>")
    phrases = spark.createDataFrame(asked + asked[:9], "phrase_id string, track_id long, words array<string>, at_s double")
    for near, reach in ((4, 15.0), (1, 6.0)):
        want = located(asked, timeline, near, reach)
        assert len(want) > 20 and {(x.phrase_id, tuple(x.token_indexes)) for x in align.locate_phrase(phrases, events, near, reach).collect()} == want


def test_a_turn_without_text_hides_no_phrase(spark, tmp_path):
    texts = ["so that it", None, "", "go this now and", "with me so from it"]
    rows = [(1, i, "user", x) for i, x in enumerate(texts)] + [(2, i, "user", "a with b that c") for i in range(0, 90, 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted((r.phrase_id, list(r.token_indexes)) for r in catalog.queries()["e11_locate_phrase"](spark, str(tmp_path)).collect())
    assert got == sorted((p, list(t)) for p, t in duck.sql(catalog.oracles()["e11_locate_phrase"]).fetchall()) and ("1:1", [1]) in got


def test_offsets_need_six_words_and_one_best(spark):
    sides = "lefts array<string>, rights array<string>"
    a = lambda i: [f"a{i}{k}" for k in range(4)]
    s = spark.createDataFrame([(1, i, 1000 * i, a(i), a(i + 50)) for i in range(5)], f"track_id long, token_index long, time_ms long, {sides}")
    tokens = [(1, i, 1000 * i + 5000 + 10 * i, a(i), a(i + 50)) for i in range(3)] + [(1, 8, 9000, a(3), a(53)), (1, 9, 99_000, a(3), a(53)), (1, 10, 4000, a(4)[:2], a(54)[:3])]
    t = spark.createDataFrame(tokens, f"track_id long, occ_index long, time_ms long, {sides}")
    assert [(r.offset_ms, r.pairs) for r in align.track_offset(s, t).collect()] == [(5010.0, 3)]


def test_direct_ground_truth(spark):
    kind = "track_id long, event_index int, start_ms long, dur_ms long, text string"
    masked = spark.createDataFrame([(1, 0, 0, 9, "so [__] it"), (1, 1, 9, 9, "end"), (2, 0, 0, 9, "so [__] it"), (3, 0, 0, 9, "so [__] it")], kind)
    plain = spark.createDataFrame([(1, 0, 0, 9, "so with it"), (1, 1, 9, 9, "other"), (2, 0, 0, 9, "so much it"), (3, 0, 0, 9, "so with it"), (3, 1, 9, 9, "more")], kind)
    lexicon = spark.createDataFrame([("with",)], "word string")
    assert [r.track_id for r in align.has_direct_ground_truth(masked, plain, lexicon).collect()] == [1]


def test_review_modes_groups_and_fusion(spark):
    rows = spark.createDataFrame([(1, "x", "y", "disagreement", False), (2, "x", "x", "agreement", False), (3, None, None, "both-empty", None), (4, "x", None, "only-a", None)], "k int, a_word string, b_word string, category string, b_correct boolean")
    pick = lambda mode: [r.k for r in review.review_queue(rows, mode).orderBy("k").collect()]
    assert (pick("misses"), pick("review"), pick("triage"), pick("false-fills"), pick("golden")) == ([1, 2], [1, 2], [1, 3, 4], [1, 2, 4], [1, 2, 3, 4])
    items = spark.createDataFrame([("a", "m", None, "N", True, "p"), ("a", "unknown", None, "n", True, "p"), ("b", "m", "1", "x", True, "p"), ("b", "m", "1", "y", True, "p"), ("c", "m", None, "x", True, "p"), ("c", "m", None, "y", True, "p"), ("d", "m", None, "x", True, "p"), ("d", "m", None, "x", True, "q")], "id string, pair_class string, creator_id string, creator string, complete boolean, auto_path string")
    assert {r.id for r in provenance.source_groups(items).where("quarantined").collect()} == {"c", "d"}
    own = spark.createDataFrame([(1, "run", 0, -0.1), (1, "ran", 1, -3.0), (2, "run", 0, -0.1), (2, "go", 1, -3.0), (3, "run", 0, -1.0), (3, "go", 1, -1.0)], "slot_id long, word string, list_order int, logp double")
    choice = spark.createDataFrame([(1, "ran", False), (2, "go", False), (3, "go", True)], "slot_id long, word string, uncertain boolean")
    families = spark.createDataFrame([("run", "r"), ("ran", "r"), ("go", "g")], "word string, family string")
    got = scored.fuse_scores(own, own.where("false"), (1.0, 0.0), 0.0, 0.6, choice, families)
    assert {r.slot_id: r.word for r in got.collect()} == {1: "ran", 2: "run", 3: "go"}
    now = spark.createDataFrame([(1, 0, "f", "c"), (1, 1, "f", None), (1, 2, "f", "d")], "track_id long, token_index int, fingerprint string, context string")
    reused = metrics.reuse_predictions(now, now.withColumn("context", F.when(F.col("token_index") < 2, F.col("context"))).withColumn("word", F.lit("w")), ("context",))
    assert metrics.reuse_counts(reused).first().asDict() == {"reused": 2, "computed": 1}


def test_compounds_and_case_of_the_match(spark):
    answers = [("show", "sideshow", "the side [__] now", True), ("show", "sideshow", "SIDE  [ __ ]", True), ("show", "sideshow", "side, [__]", False), ("show", "sideshow", None, False), ("show", "showtime", "[__] times", True), ("showww", "show", None, True), ("time", "showtime", "[__] time", False)]
    rows = spark.createDataFrame([(i, w, [e], c) for i, (w, e, c, _) in enumerate(answers)], "i int, w string, e array<string>, c string")
    got = rows.select("i", T.answers_match("w", "e", context="c", compounds=[("show", "sideshow", "side", ""), ("show", "showtime", "", "time")]).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [a[3] for a in answers]
    cases = [("so", "GET [__] NOW", "WORD"), ("so", "Get [__] NOW", "word"), ("so", "I [__]", "word"), ("end. ", "[ __ ] on", "Word"), ("OH", "on [__]", "WORD"), ("so", None, "word")]
    rows = spark.createDataFrame([(i, b, m) for i, (b, m, _) in enumerate(cases)], "i int, b string, m string")
    assert [r.w for r in rows.select("i", T.format_case(F.lit("word"), "b", "m").alias("w")).orderBy("i").collect()] == [c[2] for c in cases]


def test_limits_of_the_triage(spark):
    kinds = {"disagreement": 4, "both-empty": 40, "only-a": 9, "only-b": 3, "agreement": 20}
    rows = [(i % 3, i, "x", "y", k, False) for k, n in kinds.items() for i in range(n)]
    df = spark.createDataFrame([(a, b + 100 * j, *r) for j, (a, b, *r) in enumerate(rows)], "track_id int, token_index int, a_word string, b_word string, category string, apart boolean")

    def counts(**how):
        return {r["category"]: r["count"] for r in review.limited_queue(df, "triage", **how).groupBy("category").count().collect()}

    assert counts() == {"disagreement": 4, "both-empty": 25, "only-a": 9, "only-b": 3}
    assert counts(limit=3) == {"disagreement": 3}
    assert counts(limit=20, both_empty=6) == {"disagreement": 4, "both-empty": 6, "only-a": 7, "only-b": 3}
    assert counts(limit=500, both_empty=0) == {"disagreement": 4, "only-a": 9, "only-b": 3}
    assert sorted(r.track_id for r in review.limited_queue(df.where("category = 'only-a'"), "triage", 3).collect()) == [0, 1, 2]
    assert review.limited_queue(df, "golden", 10).count() == 10 and review.limited_queue(df, "golden").count() == 76


def test_compatibility_forms(spark):
    """All assigned code points, and pairs of a base and a mark, as Python's own tables have them."""
    signs = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    marks = [c for c in signs if unicodedata.combining(c)]
    bases = [c for c in signs if c.isalpha()][:600]
    texts = [f"a{c}b" for c in signs] + [b + m for b in bases for m in marks[::23]] + ["", "plain", "\ufb01le \u2460 \uff21\uff22"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    got = {r.i: r.n for r in rows.select("i", T.nfkc("t").alias("n")).collect()}
    assert got[-1] is None and all(got[i] == unicodedata.normalize("NFKC", t) for i, t in enumerate(texts))
    assert rows.where("i >= 0").orderBy(F.desc("i")).limit(1).select(T.context_key("t")).first()[0] == "file 1 ab"
