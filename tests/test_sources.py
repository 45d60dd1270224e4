"""Readers, publishing and the vocabulary operators on small fixed cases, and the refresh as a stream."""

import pytest
from pyspark.sql import functions as F

from slotloom.functions import text as T
from slotloom.operators import rules, vocabulary
from slotloom.sources import readers, scratch, versions
from slotloom.streaming import jobs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_publish_and_defer(spark, tmp_path):
    path, schema = f"file://{tmp_path}/out", "source string, x int"
    assert readers.published_version(spark, path) is None
    with pytest.raises(ValueError):
        readers.read_published(spark, path)
    assert readers.publish(frame(spark, [("a", 1), ("a", 2)], schema), path) == "v0"
    assert readers.publish(frame(spark, [("a", 1)], schema), path) == "deferred"
    assert readers.read_published(spark, path).count() == 2
    assert readers.publish(frame(spark, [("a", 1), ("a", 2), ("b", 1)], schema), path) == "v1"
    # a version that was begun and not ended is not read, and its number is not used again
    (tmp_path / "out" / "v2").mkdir()
    (tmp_path / "out" / "claims" / "2").write_text("")
    assert readers.read_published(spark, path).count() == 3
    assert readers.publish(frame(spark, [("a", 1), ("a", 2), ("b", 1)], schema), path) == "v3"


def test_two_writers_on_one_base_lose_nothing(spark, tmp_path, monkeypatch):
    """Each writer has read the base before the other one publishes; the later one merges."""
    path, schema = f"file://{tmp_path}/out", "source string, x int"
    base = [("a", 1), ("a", 2), (None, 5)]
    versions.publish(frame(spark, base, schema), path)
    claim, once, waits = versions._claim, [], [True]

    def late(*args):
        if waits and waits.pop():
            once.append(versions.publish(frame(spark, [*base, ("c", 7), ("d", 1), ("d", 2)], schema), path))
        return claim(*args)

    monkeypatch.setattr(versions, "_claim", late)
    assert versions.publish(frame(spark, [*base, ("a", 3), ("b", 6), ("d", 9)], schema), path) == "v2" and once == ["v1"]
    rows = lambda v=None: sorted(((r.source or "", r.x) for r in versions.read_published(spark, path, v).collect()))
    # d came from both: the one with more rows stays
    assert rows() == [("", 5), ("a", 1), ("a", 2), ("a", 3), ("b", 6), ("c", 7), ("d", 1), ("d", 2)]
    assert rows(0) == [("", 5), ("a", 1), ("a", 2)] and rows(1) == [("", 5), ("a", 1), ("a", 2), ("c", 7), ("d", 1), ("d", 2)]


def test_a_refresh_writes_what_it_changes(spark, tmp_path, monkeypatch):
    path, schema = f"file://{tmp_path}/out", "source string, source_hash string, row_id long"
    parts = lambda: {p.name: sum(1 for _ in p.glob("*.parquet")) and spark.read.parquet(str(p)).count() for p in (tmp_path / "out" / "parts").iterdir()}
    whole = [(f"s{i}", "h", 10 * i + j) for i in range(20) for j in range(5)]
    assert versions.refresh(frame(spark, whole, schema), path) == "v0"
    before = parts()
    assert versions.refresh(frame(spark, [("s3", "new", j) for j in range(6)] + [("s4", "new", 0)] + whole[:5], schema), path) == "v1"
    assert [n for p, n in parts().items() if p not in before] == [6]
    assert versions.refresh(frame(spark, [("s3", "new", j) for j in range(6)], schema), path) == "unchanged"
    monkeypatch.setattr(versions, "PARTS", 2)
    assert versions.refresh(frame(spark, [("z", "h", 1)], schema), path) == "v2"
    got = versions.read_published(spark, path)
    assert got.count() == 102 and got.columns == ["source", "source_hash", "row_id"] and got.where("source = 's4'").count() == 5
    assert len(spark.read.parquet(*[str(p) for p in (tmp_path / "out" / "parts").iterdir()]).where("source = 'z'").select("__part").distinct().collect()) == 2
    none = f"file://{tmp_path}/none"
    assert versions.publish(frame(spark, [], schema), none) == "v0" and versions.read_published(spark, none).count() == 0


def test_refresh_stream_loses_nothing(spark, tmp_path):
    """One source a batch: earlier sources stay, changed ones are rebuilt, shrunk ones stay as they were."""
    schema = "source string, source_hash string, row_id long"
    inside, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    for i, rows in enumerate([[("a", "h1", 1), ("a", "h1", 2)], [("b", "h1", 3)], [("a", "h2", 1), ("a", "h2", 2), ("a", "h2", 4)], [("a", "h3", 1)]]):
        frame(spark, rows, schema).coalesce(1).write.parquet(f"{inside}/batch{i}")
        stream = jobs.read_stream(spark, f"{inside}/batch{i}", schema)
        query = jobs.refresh_batches(stream, out, f"{tmp_path}/check{i}")
        query.processAllAvailable()
        query.stop()
    got = sorted((r.source, r.source_hash, r.row_id) for r in readers.read_published(spark, out).collect())
    assert got == [("a", "h2", 1), ("a", "h2", 2), ("a", "h2", 4), ("b", "h1", 3)]


def test_readers_check_their_tables(spark, tmp_path):
    frame(spark, [(" With ",), ("with",), ("",), ("from",)], "word string").write.parquet(f"{tmp_path}/lex")
    assert sorted(r.word for r in readers.read_lexicon(spark, f"{tmp_path}/lex").collect()) == ["from", "with"]
    priors = [("r", "with", 0.8, 0.6, 5), ("r", "from", 1.2, 0.1, 5), ("s", "from", 0.4, 0.5, 5)]
    frame(spark, priors, "rule_id string, word string, p double, margin double, support int").write.parquet(f"{tmp_path}/priors")
    assert [r.word for r in readers.read_priors(spark, f"{tmp_path}/priors").collect()] == ["with"]
    with pytest.raises(ValueError, match="lacks"):
        readers.read_priors(spark, f"{tmp_path}/lex")
    frame(spark, [("c1", "a [__] b")], "context_id string, text string").write.parquet(f"{tmp_path}/d/contexts")
    frame(spark, [("s", "h")], "source string, source_hash string").write.parquet(f"{tmp_path}/d/sources")
    rows = [("1", "c1", 0, "known", "with", None), ("2", "c1", 0, "known", None, None), ("3", "c9", 0, "unknown", None, None), ("4", "c1", 0, "ambiguous", None, ["a", "b"]), ("5", "c1", 0, "ambiguous", None, ["a"]), ("6", "c1", 0, "odd", None, None), ("7", "c1", 0, "unknown", "with", None)]
    frame(spark, rows, "row_id string, context_id string, slot_index int, label_status string, expected string, expected_candidates array<string>").write.parquet(f"{tmp_path}/d/rows")
    tables, bad = readers.read_discovery(spark, f"{tmp_path}/d")
    assert tables["rows"].count() == 7 and sorted(r.key for r in bad.collect()) == ["2", "3", "5", "6", "7"]


def test_lexicon_words(spark):
    lexicon = frame(spark, [("with",), ("from now on",), ("now",), ("this",)], "word string")
    rows = frame(spark, [(1, "With this, from now on: NOW and this's end; nowhere"), (2, None), (3, "")], "track_id long, text string")
    got = sorted((r.track_id, r.pos, r.label) for r in vocabulary.extract_lexicon(rows, lexicon).collect())
    assert got == [(1, 0, "with"), (1, 1, "this"), (1, 2, "from now on"), (1, 5, "now"), (1, 7, "this")]


def test_compounds_and_families(spark):
    labels = frame(spark, [(1, "backward", None, "ward"), (2, "backward", None, "up"), (3, "inside", "in", None)], "id int, label string, left string, right string")
    compounds = frame(spark, [("backward", "right", "ward", "back"), ("inside", "left", "in", "side")], "label string, side string, visible string, out string")
    assert {r.id: r.label for r in vocabulary.normalize_compound(labels, compounds).collect()} == {1: "back", 2: "backward", 3: "side"}
    pairs = frame(spark, [("run", "ran"), ("run", "run"), ("run", "go"), (None, "run")], "a string, b string")
    families = frame(spark, [("run", "run"), ("ran", "run"), ("go", "go")], "word string, family string")
    assert [(r.a, r.b) for r in vocabulary.same_family(pairs, families).where("same_family").collect()] == [("run", "ran")]
    rows = frame(spark, [("manual", ["a"], None, "Ann"), ("auto-auto", ["a", "b"], False, "N/A"), (None, None, True, None)], "pair_class string, expected array<string>, evidence boolean, name string")
    out = rows.select(vocabulary.tier("pair_class").alias("t"), vocabulary.single_label("expected").alias("s"), vocabulary.eligible("evidence").alias("e"), vocabulary.known_creator(F.lit(""), "name").alias("c")).collect()
    assert [tuple(r) for r in out] == [("manual-auto", True, True, True), (None, False, False, False), (None, False, True, False)]


def test_case_and_punctuation(spark):
    cases = [("I LIKE ", "", "WORD"), ("he said: LOOK A ", "", "WORD"), ("Stop. ", "", "Word"), ("", "", "word"), ("plain text ", "", "word"), ("a ", " Then we go", "word."), ("a ", " >> yes", "word."), ("what the ", " I saw", "word."), ("what the ", " you saw", "word"), ("a ", " then", "word"), ("a ", " STOP it", "word.")]
    rows = frame(spark, [(i, *c) for i, c in enumerate(cases)], "i int, before string, after string, want string")
    got = rows.select("i", "want", T.format_punct(T.format_case(F.lit("word"), "before"), "before", "after").alias("got")).orderBy("i").collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want if r.i != 7 else "word") for r in got]


def test_long_segments_are_joined(spark):
    slots = frame(spark, [("2024-01-01 05:00:00", 1, 7)], "ts string, track_id long, slot_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    segments = frame(spark, [("2024-01-01 00:00:00", "2024-01-01 06:00:00", 1, 3)], "start_ts string, end_ts string, track_id long, segment_id long").withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")})
    assert jobs.stream_join_segments(slots, segments).count() == 1


def test_prior_fills_whatever_its_share(spark):
    matches = frame(spark, [(1, 0, "r", ["with", "from", "this"])], "track_id long, token_index int, rule_id string, candidates array<string>")
    priors = frame(spark, [("r", "from", 0.4)], "rule_id string, word string, p double")
    assert rules.decide(matches, priors).first().word == "from" and rules.decide(matches, priors, least=0.5).first().word is None


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
