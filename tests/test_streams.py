"""Streams with state give what their batch twins give, whatever the batches."""

import tempfile

from slotloom.operators import slots
from slotloom.streaming import jobs


def through(spark, rows, schema, job, name, mode, size=3):
    """The rows as files of ``size`` rows, one a batch, through a job."""
    folder, point = tempfile.mkdtemp(prefix="slotloom-"), tempfile.mkdtemp(prefix="slotloom-")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.run_to_table(job(jobs.read_stream(spark, folder, schema)), name, point, mode).collect()


def test_fill_cache(spark):
    schema = "slot_id long, seq long, word string, source string"
    lexicon = spark.createDataFrame([("with",), ("This",)], "word string")
    rows = [(1, 0, "with", "media"), (1, 1, "no", "rule"), (2, 2, "with", "media"), (2, 3, "this", "rule"), (3, 4, "with", "media"), (3, 5, "", "media"), (4, 6, "with", "rule"), (4, 7, "no", "rule"), (4, 8, "no", "media"), (5, 9, "no", "media"), (6, 10, "with", "media"), (6, 11, "no", "rule"), (6, 12, "this", "media"), (7, 13, None, "media")]
    want = {(2, "this", "rule"), (4, "with", "rule"), (6, "this", "media")}
    assert {tuple(r) for r in jobs.fill_cache(spark.createDataFrame(rows, schema), lexicon).collect()} == want
    last = {}
    for r in sorted(through(spark, rows, schema, lambda s: jobs.fill_cache_state(s, lexicon), "fills", "update"), key=lambda r: r.seq):
        last[r.slot_id] = (r.slot_id, r.word, r.source)
    assert {x for x in last.values() if x[1]} == want


def test_windows_are_packed(spark):
    schema = "track_id long, token_index int, time_s double"
    rows = [(t, i, float(x)) for t in (1, 2) for i, x in enumerate((3, 20, 28.5, 29, 90, 91, 130 + t))]
    rows.sort(key=lambda r: r[2])
    batch = {tuple(r) for r in slots.speech_windows(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r) for r in through(spark, rows, schema, jobs.pack_windows, "packed", "append", 4)} == batch
    assert sorted(r[2] for r in batch if r[0] == 1) == [0, 0, 0, 1, 2, 2, 3]


def test_speed(spark):
    schema = "device string, seq long, seconds double, slots int"
    rows = [(d, i, 0.5 + (i * 7 % 5) / 3, 1 + i % 3) for i in range(12) for d in "ab"]
    batch = {(r.device, r.seq, round(r.median, 9), r.fast) for r in jobs.speed_monitor(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.device, r.seq, round(r.median, 9), r.fast) for r in through(spark, rows, schema, jobs.speed_state, "speed", "append", 9)} == batch and len(batch) == 24


def test_generations(spark):
    schema = "session long, track_id long, generation long, slot_id long, seq long"
    rows = [(1, 7, 1, 10, 0), (1, 7, 1, 11, 1), (1, 7, 1, 12, 2), (1, 7, 2, 11, 3), (1, 7, 2, 13, 4), (1, 7, 1, 12, 5), (1, 8, 3, 20, 6), (2, 9, 1, 1, 7)]
    got = [(r.track_id, r.generation, r.slot_id, r.action) for r in through(spark, rows, schema, jobs.generation_state, "generations", "append") if r.session == 1]
    assert [x for x in got if x[3] == "publish"] == [(7, 1, 10, "publish"), (7, 1, 11, "publish"), (7, 1, 12, "publish"), (7, 2, 11, "publish"), (7, 2, 13, "publish"), (8, 3, 20, "publish")]
    assert {x for x in got if x[3] == "retire"} == {(7, 1, 10, "retire"), (7, 1, 12, "retire"), (7, 2, 11, "retire"), (7, 2, 13, "retire")}


def test_resolutions(spark):
    schema = "slot_id long, seq long, word string, source string"
    rows = [(1, 0, "a", "media"), (1, 1, "b", "rule"), (1, 2, "c", "media"), (2, 3, None, "odd"), (1, 4, "d", "context"), (2, 5, "x", "confirmed"), (2, 6, "y", "rule"), (3, 7, "z", None)]
    last = {}
    for r in through(spark, rows, schema, jobs.resolve_state, "resolved", "update", 2):
        last[r.slot_id] = max(last.get(r.slot_id, ()), (r.seq, r.word, r.source))
    batch = {(r.slot_id, r.word, r.source) for r in jobs.resolve_batch(spark.createDataFrame(rows, schema)).collect()}
    assert {(k, *v[1:]) for k, v in last.items()} == batch == {(1, "d", "context"), (2, "x", "confirmed"), (3, "z", None)}


def test_state_ends_when_the_watermark_has_passed(spark):
    """A slot's, and a session's, state is gone hours later: what came before no longer counts. One seen in between stays."""
    from datetime import datetime, timedelta

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    schema = "slot_id long, seq long, word string, source string, ts timestamp"
    rows = [(1, 0, "a", "confirmed", at(0)), (2, 1, "b", "confirmed", at(0)), (2, 2, "c", "media", at(9)), (9, 3, "w", "media", at(9)), (9, 4, "w", "media", at(9.1)), (1, 5, "new", "media", at(9.2)), (2, 6, "no", "media", at(9.2)), (9, 7, "v", "media", at(9.3))]
    job = lambda s: jobs.resolve_state(s, late="1 minute", keep_ms=10 * jobs.HOUR_MS)
    kept = [(r.slot_id, r.word) for r in through(spark, rows, schema, job, "kept", "update", 1) if r.slot_id < 9]
    assert sorted(kept) == [(1, "a"), (2, "b")]
    gone = [(r.slot_id, r.word) for r in through(spark, rows, schema, lambda s: jobs.resolve_state(s, late="1 minute"), "gone", "update", 1) if r.slot_id < 9]
    assert (1, "new") in gone and (1, "a") in gone


def test_late_slots_come_back_after_a_seek(spark, tmp_path):
    schema = "track_id long, slot_id long, time_s double, playhead_s double"
    batches = [[(1, 1, 10.0, 5.0), (1, 2, 3.0, 5.0)], [(1, 3, 8.0, 9.0), (1, 4, 8.0, 9.5), (2, 5, 1.0, 50.0), (2, 6, 1.0, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = jobs.late_sinks(jobs.read_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/live", f"{tmp_path}/side", f"{tmp_path}/check")
        query.processAllAvailable()
        query.stop()
    of = lambda name: {r.slot_id for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
    assert of("live") == {1, 3, 6} and of("side") == {2, 4, 5}
    seeks = spark.createDataFrame([(1, 7.0), (2, 60.0)], "track_id long, playhead_s double")
    assert [(r.slot_id, r.playhead_s) for r in jobs.after_seek(spark, f"{tmp_path}/side", seeks).collect()] == [(4, 7.0)]
