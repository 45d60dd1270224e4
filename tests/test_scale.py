"""What shows only on larger tables, forced on small ones."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slotloom.llm import bpe
from slotloom.operators import align, chains, mining, rules, sampling, slots


def shuffled(spark) -> int:
    """Records that shuffles have written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()).iterator()
    n = 0
    while stages.hasNext():
        n += stages.next().shuffleWriteRecords()
    return n


def test_numbers_do_not_depend_on_the_bounds_drawn(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.rangeExchange.sampleSizePerPartition")}
    try:
        for k, v in zip(held, ("8", "1")):
            spark.conf.set(k, v)
        rows = sampling.numbered(spark.range(20_000).withColumn("more", F.col("id") * 2).repartition(4, "id"), "id")
        assert [r.position for r in sorted(rows.collect(), key=lambda r: r.id)] == list(range(20_000))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_a_condition_of_all_leads_pairs_nothing(spark):
    features = spark.range(400).select(F.concat(F.lit("r"), "id").alias("row_id"), F.explode(F.array(F.struct(F.lit(2).alias("off"), F.lit("end").alias("tok")), F.struct(F.lit(1).alias("off"), F.concat(F.lit("w"), F.col("id") % 200).alias("tok")))).alias("f")).select("row_id", "f.*")
    both = F.array(*[F.struct(F.lit(o).alias("off"), t.alias("tok")) for o, t in ((1, F.concat(F.lit("w"), "id")), (2, F.lit("end")))])
    leads = spark.range(300).select(F.concat(F.lit("l"), "id").alias("lead"), both.alias("conditions"))
    before = shuffled(spark)
    got = {(r.lead, r.row_id) for r in align.lead_evidence(leads, features).collect()}
    assert got == {(f"l{i % 200}", f"r{i}") for i in range(400)}
    assert shuffled(spark) - before < 20_000


def test_slots_are_never_broadcast(spark, monkeypatch):
    """Few slots and many rules: neither the exploded slots nor rules over the limit are broadcast."""
    token = "struct<off:int,tok:string>"
    slots = spark.createDataFrame([(1, i, [(-1, f"w{i}"), (1, "x")]) for i in range(5)], f"track_id long, token_index int, features array<{token}>")
    table = spark.range(50).select(F.concat(F.lit("r"), "id").alias("rule_id"), F.array(F.struct(F.lit(-1).alias("off"), F.concat(F.lit("w"), "id").alias("tok"))).alias("conditions"), F.lit(-1).alias("anchor_off"), F.concat(F.lit("w"), "id").alias("anchor_tok"))
    for most, joins in ((50, "BroadcastHashJoin"), (49, "SortMergeJoin")):
        monkeypatch.setattr(rules, "RULES", most, raising=False)
        found = rules.candidate_matches(slots, table)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert joins in plan and "BuildLeft" not in plan
        assert sorted(r.rule_id for r in found.collect()) == [f"r{i}" for i in range(5)]


def test_texts_of_a_batch_come_in_slices(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 100)
    texts = ["a" * 30] * 7 + [None, "ü" * 400, "b", ""] + ["c"] * 300
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(bpe.slices(iter([whole, whole.slice(0, 0)])))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and len(parts) > 5
    assert max(sum(len(t or "") for t in p.column(1).to_pylist() if len(t or "") <= 100) for p in parts) <= 200


def test_a_context_is_made_once_a_line_not_once_a_slot(spark):
    """A line of 300 slots: its long context is never copied to each of them."""
    text = "a [__] " * 300
    events = spark.createDataFrame([(1, 0, 0, 900, text), (1, 1, 900, 300, "no slot"), (2, 0, 0, 300, "[__]")], "track_id long, event_index int, start_ms long, dur_ms long, text string")
    found = slots.extract_slots(events)
    got = slots.slotted_contexts(found, events, 0, 0)
    assert got.count() == 2 and found.count() == 301
    both = [{r.context_id for r in slots.context_dim(c).collect()} for c in (got, slots.slot_context(found, events, 0, 0))]
    assert both[0] == both[1] and len(both[0]) == 2


def test_conditions_are_made_once_a_row(spark):
    """Sorting a row's features and writing its conditions stands once in the plan, not in each pair and phrase of it."""
    rows = spark.createDataFrame([("r", [(1, "y"), (-1, "x"), (-2, "w"), (2, "z")]), ("s", [(1, "y")]), ("t", [])], "row_id string, features array<struct<off:int,tok:string>>")
    keyed = mining.row_conditions(rows)
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1
    want = {(r.row_id, k) for r in rows.select("row_id", mining.condition_keys("features").alias("k")).collect() for k in r.k}
    assert len(want) == 14 and sorted(map(tuple, keyed.collect())) == sorted(want)


def test_timed_units_are_those_of_slots_and_words(spark):
    """The same slots, words and times as by the whole text of each, and no text or array of words beside them."""
    rows = [(1, 0, 0, 900, "from [__] to [ __ ] it's"), (1, 1, 900, 0, ""), (1, 2, 900, 1200, "[__][__] That, x [__]."), (2, 0, 0, 300, "That")]
    events = spark.createDataFrame(rows, "track_id long, event_index int, start_ms long, dur_ms long, text string")
    marks = slots.timed_units(events, lambda u: u == "[__]")
    assert not any(c in marks._jdf.queryExecution().optimizedPlan().toString().split("Sort")[0].split("Window")[0] for c in ("units#", "text#"))
    by_text = slots.slot_times(slots.extract_slots(events))
    assert sorted((r.track_id, r.number, r.time_s) for r in marks.collect()) == sorted((r.track_id, r.token_index, r.time_s) for r in by_text.collect())
    words = slots.spoken_words(events).where("lower(unit) = 'that'")
    assert sorted((r.track_id, r.position, r.unit, r.time_s) for r in slots.timed_units(events, lambda u: F.lower(u) == "that").collect()) == sorted(map(tuple, words.collect()))


def test_slots_that_stand_alone_need_no_steps():
    """Only slots that share occurrences, or those over an end of the block, are walked one by one."""
    times = np.arange(1000) * 10_000
    starts = np.sort(np.concatenate([times + 300, times + 500, [-100]]))
    block = chains.Block(times, starts, starts + 200, 1500, 0, 10_000_000)
    assert block.rest.tolist() == [0] and len(block.alone) == 999
    want = [(i, 2 * i + 1, 300) for i in range(1, 1000)]
    assert block.matches(0, chains.ANY)[1:] == want
    near = chains.Block(np.array([0, 100, 9000]), np.array([50, 8000, 8900]), np.array([60, 8100, 8950]), 1500, -5000, 20_000)
    assert near.rest.tolist() == [0, 1] and near.matches(0, chains.ANY) == [(1, 0, 40), (2, 2, 50)]


def test_slots_are_dealt_by_number_before_patterns_are_made(spark, monkeypatch):
    """What a task makes patterns of is bounded by a count, whatever the bytes of the slots."""
    rows = spark.range(400).select(F.col("id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(o).alias("off"), F.concat(F.lit("w"), F.col("id") % 7).alias("tok"), F.lit("c").alias("cls")) for o in (-2, -1, 1, 2)])).alias("f")).select("row_id", "f.*")
    whole = sorted(map(tuple, mining.class_patterns(rows).collect()))
    monkeypatch.setattr(mining, "TOKENS", 40)
    dealt = mining.class_patterns(rows)
    assert dealt.rdd.getNumPartitions() == 40 and sorted(map(tuple, dealt.collect())) == whole and len(whole) == 400 * 48


def shuffled_mb(spark) -> float:
    """MB that shuffles have written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()).iterator()
    n = 0
    while stages.hasNext():
        n += stages.next().shuffleWriteBytes()
    return n / 1e6


def test_the_words_of_an_event_are_not_copied_to_its_phrases(spark):
    """Eight events of 1,000 words and 200 phrases near them: 8,000 words are moved, not 1,600,000."""
    word = F.concat(F.lit("w"), F.hash("k", "id").cast("string"))
    shown = lambda w, t: F.struct(w.alias("word"), t.cast("int").alias("token_index"), F.lit(None).cast("string").alias("resolved"))
    words = spark.range(8).select("id", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k")).select("id", "k", F.when(F.col("k") % 40 == 39, shown(F.lit("[__]"), F.col("id") * 25 + F.floor(F.col("k") / 40))).otherwise(shown(word, F.lit(None))).alias("t"))
    at = F.col("id") * 2.0
    timeline = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("x")).select(F.lit(1).cast("long").alias("track_id"), F.col("id").cast("int").alias("event_index"), at.alias("start_s"), (at + 2).alias("end_s"), F.transform("x", lambda x: x["t"]).alias("words")).cache()
    places = timeline.select("*", F.explode(F.filter(F.sequence(F.lit(1), F.lit(998)), lambda i: i % 40 == 39)).alias("i"))
    near = F.transform(F.slice("words", F.col("i"), 3), lambda t: t["word"])
    phrases = places.select(F.concat_ws(":", "event_index", "i").alias("phrase_id"), "track_id", near.alias("words"), F.lit(7.5).alias("at_s"), F.get("words", F.col("i"))["token_index"].alias("token")).cache()
    assert timeline.count() == 8 and phrases.count() == 192
    before = shuffled_mb(spark)
    got = {(r.phrase_id, tuple(r.token_indexes)) for r in align.locate_phrase(phrases.drop("token"), timeline).collect()}
    assert got == {(r.phrase_id, (r.token,)) for r in phrases.collect()}
    assert shuffled_mb(spark) - before < 1
    timeline.unpersist()
    phrases.unpersist()
