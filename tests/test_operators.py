"""Edge cases on small frames."""

import tempfile

from pyspark.sql import functions as F

from slotloom.functions import text as T
from slotloom.operators import align, metrics, mining, rules, sampling, slots
from slotloom.sources import readers
from slotloom.streaming import jobs


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, T.normalize_mask("t"), t="a [ __ ] b [__]") == "a [__] b [__]"
    assert one(spark, T.strip_labels("t"), t="[music] so [__] goes [applause]") == "so [__] goes"
    assert one(spark, T.rule_words("t"), t="Don’t [ __ ] * it") == ["don't", "[__]", "*", "it"]
    assert one(spark, T.squeeze("t"), t="Sooooo") == "so"
    assert one(spark, T.content_fingerprint("t"), t="hello") == "m3bicr"
    assert one(spark, T.format_case("w", "b"), w="that", b="OH MY") == "THAT"
    assert one(spark, T.format_case("w", "b"), w="that", b="end.") == "That"
    assert one(spark, T.format_punct("w", "b", "a"), w="that", b="what is", a="The end") == "that."
    assert [(r["token"], r["offset"]) for r in one(spark, T.discovery_tokens("t"), t="<b>a</b> bc  d")] == [("a", 3), ("bc", 9), ("d", 13)]
    assert one(spark, T.creator_key("i", "n"), i="x", n="  Some  One ") == "name:some one"
    assert one(spark, T.creator_key("i", "n"), i="x", n="N/A") is None


def test_slots_and_windows(spark):
    events = spark.createDataFrame([(1, 0, 0, 2000, "a [__] b [__]"), (1, 1, 2000, 1000, "c"), (1, 2, 3000, 0, "[__]")], "track_id long, event_index int, start_ms long, dur_ms long, text string")
    found = slots.extract_slots(events)
    assert [(r.token_index, r.event_index, r.char_off) for r in found.orderBy("token_index").collect()] == [(0, 0, 2), (1, 0, 9), (2, 2, 0)]
    times = slots.slot_times(found)
    assert [r.time_s for r in times.orderBy("token_index").collect()] == [0.5, 1.5, 3.0]
    far = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((3, 20, 28.5, 29, 90))], "track_id long, token_index int, time_s double")
    assert [r.window_no for r in slots.speech_windows(far).orderBy("token_index").collect()] == [0, 0, 0, 1, 2]
    assert slots.merge_intervals(far).count() == 1
    context = spark.createDataFrame([("x [__] y [__] z", 1)], "c string, i int")
    assert context.select(slots.only_target("c", "i")).first()[0] == "x … y [__] z"


def test_equal_intervals_are_one_island(spark):
    """Two equal intervals that open an island, dealt in two orders: no interval that is returned overlaps another."""
    times = {1: [10.2, 10.7, 43.0], 2: [40.0, 40.0, 40.0, 300.0, 300.0], 3: [0.0, 0.0, 500.5, 500.6, 560.0, 1000.0]}
    rows = [(k, i, t) for k, own in times.items() for i, t in enumerate(own)]
    want = [(1, 0, 73, 3), (2, 5, 70, 3), (2, 265, 330, 2), (3, 0, 30, 2), (3, 465, 590, 3), (3, 965, 1030, 1)]
    for dealt in (rows, rows[::-1]):
        df = spark.createDataFrame(dealt, "track_id long, token_index int, time_s double").repartition(3)
        assert sorted(tuple(r[c] for c in ("track_id", "start_s", "end_s", "n")) for r in slots.merge_intervals(df).collect()) == want


def test_rules(spark):
    patterns = spark.createDataFrame([(1, 2, [["a", "b"], ["c"], ["d", "e"]])], "group_no long, pattern_no long, parts array<array<string>>")
    got = rules.expand_rules(patterns).orderBy("ord").collect()
    assert [r.template for r in got] == ["a c d", "a c e", "b c d", "b c e"] and got[1].ord == 1_002_000_001
    matches = spark.createDataFrame([(1, 0, 2, "r1", 5), (1, 1, 1, "r2", 1), (1, 2, 1, "r3", 9)], "track_id long, token_index int, span int, rule_id string, ord long")
    assert [r.rule_id for r in rules.resolve_overlaps(matches).orderBy("token_index").collect()] == ["r2", "r3"]
    context = spark.createDataFrame([("so [__] the end",), ("[__] a the",)], "context string")
    assert [r.matched for r in rules.pattern_match(context, "so [this|that] the").collect()] == [True, False]
    compiled = rules.compile_rules(spark.createDataFrame([("^ go [a|b c] * on",)], "template string")).first()
    assert compiled.candidates == ["a", "b c"] and compiled.blanks == 2 and [(c.off, c.tok) for c in compiled.conditions] == [(-2, "<BOS>"), (-1, "go"), (2, "on")]


def test_segment_times_and_pages(spark):
    page = '{"wpWinPositions":[{"rcRows":%d}],"events":[{"tStartMs":0,"dDurationMs":5000,"segs":[{"utf8":"a\\n[__]"}]},{"tStartMs":2000,"dDurationMs":900,"segs":[{"utf8":"so ","tOffsetMs":0},{"utf8":"[ __ ] b","tOffsetMs":400}]},{"tStartMs":1000,"segs":[]}]}'
    tracks = spark.createDataFrame([(1, page % 2), (2, page % 1)], "track_id long, payload string")
    events = slots.event_durations(readers.parse_payload(tracks))
    # Only the fixed page's event ends at the next start, which is the least of all later ones.
    assert [(r.track_id, r.fixed_dur_ms) for r in events.orderBy("track_id", "event_index").collect()] == [(1, 1000), (1, 900), (1, 0), (2, 5000), (2, 900), (2, 0)]
    times = slots.slot_times(slots.extract_slots(events.drop("dur_ms").withColumnRenamed("fixed_dur_ms", "dur_ms")))
    assert [(r.track_id, r.token_index, r.time_s) for r in times.orderBy("track_id", "token_index").collect()] == [(1, 0, 0.5), (1, 1, 2.4), (2, 0, 2.5), (2, 1, 2.4)]


def test_guard_trace_and_fills(spark):
    tracks = spark.createDataFrame([(1, "go [__] [__] now so [__] on")], "track_id long, text string")
    around = slots.slot_features(tracks, 1, 1)
    table = spark.createDataFrame([("r1", 1, ["x"], [(-1, "go")], -1, "go"), ("r2", 2, ["y", "z"], [(-1, "so")], -1, "so")], "rule_id string, ord long, candidates array<string>, conditions array<struct<off:int,tok:string>>, anchor_off int, anchor_tok string")
    found = rules.candidate_matches(around, table)
    assert [(r.token_index, r.rule_id) for r in found.collect()] == [(2, "r2")]
    assert rules.candidate_matches(around, table.withColumn("kept", F.array(F.lit(1)))).count() == rules.candidate_matches(around, table.withColumn("blanks", F.lit(2))).count() == 2
    decided = found.withColumn("word", F.lit("y"))
    assert [r.status for r in rules.trace(around, decided).orderBy("token_index").collect()] == ["none", "none", "winner"]
    assert [r.status for r in rules.trace(around, found).where("rule_id = 'r2'").collect()] == ["abstain"]
    fills = spark.createDataFrame([(1, 0, "a", ["a"]), (1, 2, "y", ["y", "z"])], "track_id long, token_index int, word string, candidates array<string>")
    over = spark.createDataFrame([(1, 0, "b"), (1, 1, ""), (1, 2, "q")], "track_id long, token_index int, word string")
    text = lambda **k: rules.apply_fills(tracks, fills, **k).first().text
    assert text() == "go a [__] now so y on" and text(ambiguous=False) == "go a [__] now so [__] on"
    assert text(overrides=over) == "go b [__] now so q on" and text(overrides=over, prefer_rules=True) == "go a [__] now so y on"


def test_alignment(spark):
    masked = spark.createDataFrame([(1, 0, 0, 9, "I saw [__] cat [__]"), (1, 1, 9, 9, "[__] it")], "track_id long, event_index int, start_ms long, dur_ms long, text string")
    plain = spark.createDataFrame([(1, 0, 0, 9, "I saw that cat over there"), (1, 1, 9, 9, "this it")], masked.schema)
    got = {(r.event_index, r.slot_in_event): (r.expected, r.status) for r in align.align_direct(masked, plain).collect()}
    assert got == {(0, 0): ("that", "known"), (0, 1): ("over there", "ambiguous"), (1, 0): ("this", "known")}
    s = spark.createDataFrame([(1, 0, 1000), (1, 1, 1200), (1, 2, 90_000)], "track_id long, token_index long, time_ms long")
    o = spark.createDataFrame([(1, 0, "a", 1100, 1150), (1, 1, "b", 1900, 1950), (1, 2, "c", 95_000, 95_100)], "track_id long, occ_index long, word string, start_ms long, end_ms long")
    assert {(r.token_index, r.word) for r in align.align_time(s, o, 1500).collect()} == {(0, "a"), (1, "b")}
    assert align.align_time(s, o.where("word = 'none'"), 1500).count() == 0


def test_mining_keys(spark):
    f = spark.createDataFrame([([(-2, "w"), (-1, "x"), (1, "y"), (2, "z")],)], "f array<struct<off:int,tok:string>>")
    keys = f.select(mining.condition_keys("f")).first()[0]
    assert len(keys) == len(set(keys)) == 4 + 6 + 3 and "-1=x&1=y" in keys and "-2=w&-1=x&1=y&2=z" in keys
    leaf = spark.createDataFrame([("-2=a&1=b",), ("1=<EOS>",)], "k string")
    assert [r[0] for r in leaf.select(mining.render_pattern("k")).collect()] == ["a * [_] b", None]


def test_metrics(spark):
    schema = "track_id long, token_index int, creator string, pair_class string, expected string, word string, candidates array<string>, rule_id string"
    p = spark.createDataFrame([(1, 0, "a", "m", "x", "x", ["x"], "r"), (1, 1, "a", "m", "x", "y", ["y"], "r"), (1, 2, None, "m", None, "y", ["y"], "r"), (1, 3, "b", "m", "x", None, None, None)], schema)
    r = metrics.summarize(p).first()
    assert (r.slots, r.scored, r.attempted, r.correct, r.precision, round(r.coverage, 4)) == (4, 3, 2, 1, 0.5, 0.3333)
    assert metrics.summarize(p.where("false")).first().precision is None
    assert metrics.creator_macro(p).first().creators == 2


def test_sampling(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in sampling.distributed_sample(df, 4, "k").orderBy("k").collect()] == [0, 3, 6, 9]
    assert sampling.distributed_sample(df, 50, "k").count() == 10
    assert sampling.numbered(df, "k").where("position <> k").count() == 0


def test_publish_defers(spark):
    path = "file://" + tempfile.mkdtemp(prefix="slotloom-")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, x int")
    assert readers.publish(rows, path) == "v0"
    assert readers.publish(rows.where("x <> 2"), path) == "deferred"
    assert readers.publish(rows.union(rows), path) == "v1"
    assert readers.read_published(spark, path).count() == 6


def test_streams_agree_with_batch(spark):
    folder, point = tempfile.mkdtemp(prefix="slotloom-"), tempfile.mkdtemp(prefix="slotloom-")
    schema = "slot_id long, seq long, word string, source string"
    rows = [(1, 0, "a", "media"), (1, 1, "b", "rule"), (1, 2, "c", "media"), (2, 3, "d", "confirmed"), (2, 4, "e", "rule"), (3, 5, "f", "media"), (3, 6, "g", "media")]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.resolve_state(jobs.read_stream(spark, folder, schema))
    out = jobs.run_to_table(stream, "resolved", point, "update")
    last = out.groupBy("slot_id").agg(F.max_by("word", "seq").alias("word"))
    assert {(r.slot_id, r.word) for r in last.collect()} == {(r.slot_id, r.word) for r in jobs.resolve_batch(spark.createDataFrame(rows, schema)).collect()} == {(1, "b"), (2, "d"), (3, "g")}


def test_stream_dedup(spark):
    folder, point = tempfile.mkdtemp(prefix="slotloom-"), tempfile.mkdtemp(prefix="slotloom-")
    schema = "ts timestamp, track_id long, event_index int, text string"
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts, 1L AS track_id, 0 AS event_index, 'a [__] b [__]' AS text")
    for _ in range(2):
        rows.write.mode("append").parquet(folder)
    slots_ = jobs.stream_dedup(jobs.stream_slots(jobs.read_stream(spark, folder, schema)))
    assert jobs.run_to_table(slots_, "deduped", point).count() == 2
