"""Annotation and review tables: append-only events, latest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USABLE, BLOCKING = ["labeled", "corrected"], ["unusable", "rejected"]


def compare_modes(a: DataFrame, b: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Agreement, disagreement, only-a, only-b or both-empty of two runs; ``apart`` where their times differ."""
    joined = a.select("track_id", "token_index", F.col("word").alias("a_word"), F.col("time_s").alias("a_time")).join(b.select("track_id", "token_index", F.col("word").alias("b_word"), F.col("time_s").alias("b_time")), ["track_id", "token_index"], "full_outer")
    kind = F.when(F.col("a_word").isNull() & F.col("b_word").isNull(), "both-empty").when(F.col("b_word").isNull(), "only-a").when(F.col("a_word").isNull(), "only-b").when(F.col("a_word") == F.col("b_word"), "agreement").otherwise("disagreement")
    return joined.select("track_id", "token_index", "a_word", "b_word", kind.alias("category"), F.coalesce(F.abs(F.col("a_time") - F.col("b_time")) > tolerance, F.lit(False)).alias("apart"))


def review_queue(compared: DataFrame, mode: str, external: DataFrame | None = None) -> DataFrame:
    """M1: the slots that a mode is for. compared: E14's rows, with b_correct (null: not scored) if the slots have labels.
    disagreements; misses: the second run's word is wrong or lacking though there is a label (without labels: both are
    empty); review: both of these; triage: all but agreements; golden: all; false-fills: every fill of the first run;
    external: those that another review names (external: track_id, token_index, rank), with its rank."""
    if mode == "external":
        return compared.join(external.select("track_id", "token_index", "rank"), ["track_id", "token_index"]).where("b_time IS NOT NULL" if "b_time" in compared.columns else "true")
    apart = F.col("category") == "disagreement"
    missed = F.coalesce(~F.col("b_correct"), F.lit(False)) if "b_correct" in compared.columns else F.col("category") == "both-empty"
    return compared.where({"disagreements": apart, "misses": missed, "review": apart | missed, "triage": F.col("category") != "agreement", "golden": F.lit(True), "false-fills": F.col("a_word").isNotNull()}[mode])


def _in_turn(rows: DataFrame, k: int | None) -> DataFrame:
    """k of the rows (all without k), tracks taking turns; only the first k of an order are brought together."""
    if k is None:
        return rows
    turn = rows.withColumn("__turn", F.row_number().over(Window.partitionBy("track_id").orderBy("token_index")))
    return turn.orderBy("__turn", "track_id").limit(k).drop("__turn")


def limited_queue(compared: DataFrame, mode: str, limit: int = 0, both_empty: int = 25) -> DataFrame:
    """M1 with limits (0: none). triage: disagreements first, then at most ``both_empty`` slots that both runs leave empty,
    then the two one-sided kinds by halves, what one leaves unused going to the other; tracks take turns within a kind.
    golden and others: the first by the hash of the slot. Only four counts come to the driver."""
    queue = review_queue(compared, mode)
    if mode != "triage":
        return queue.orderBy(F.sha2(F.concat_ws(":", "track_id", "token_index"), 256), "track_id", "token_index").limit(limit) if limit else queue
    kind = lambda c: queue.where(F.col("category") == c)
    if not limit:
        return kind("disagreement").union(kind("only-a")).union(kind("only-b")).union(_in_turn(kind("both-empty"), both_empty))
    n = {r["category"]: r["count"] for r in queue.groupBy("category").count().collect()}
    take = {"disagreement": min(n.get("disagreement", 0), limit)}
    left = limit - take["disagreement"]
    take["both-empty"] = min(n.get("both-empty", 0), both_empty, left)
    left -= take["both-empty"]
    first = min(n.get("only-a", 0), (left + 1) // 2)
    take["only-b"] = min(n.get("only-b", 0), left - first)
    take["only-a"] = min(n.get("only-a", 0), left - take["only-b"])
    parts = [_in_turn(kind(c), k) for c, k in take.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def annotation_history(annotations: DataFrame) -> DataFrame:
    """M2: the latest usable label of a slot, unless a later one blocks the slot, or any blocks its fixture.
    annotations: fixture, slot_id (null: the whole fixture), seq, status, word."""
    whole = annotations.where(F.col("slot_id").isNull() & F.col("status").isin(BLOCKING)).select("fixture").distinct()
    last = annotations.where(F.col("slot_id").isNotNull() & F.col("status").isin(USABLE + BLOCKING)).groupBy("fixture", "slot_id").agg(F.max_by(F.struct("status", "word"), "seq").alias("l"))
    return last.where(F.col("l.status").isin(USABLE)).join(whole, "fixture", "left_anti").select("fixture", "slot_id", F.col("l.word").alias("word"))


def propagate_label(queue: DataFrame, fixtures: DataFrame) -> DataFrame:
    """M3: a fixture's status for its pending slots. fixtures: fixture, fixture_status."""
    joined = queue.join(fixtures, "fixture", "left")
    return joined.withColumn("status", F.when((F.col("status") == "pending") & F.col("fixture_status").isNotNull(), F.col("fixture_status")).otherwise(F.col("status"))).drop("fixture_status")


def group_by_caption(selected: DataFrame, slots: DataFrame) -> DataFrame:
    """M4: all slots of the events that a selection touches, if the event's slots are complete (0 .. n - 1)."""
    touched = selected.select("track_id", "event_index").distinct()
    whole = slots.groupBy("track_id", "event_index").agg(F.count("*").alias("n"), F.max("slot_in_event").alias("last")).where(F.col("n") == F.col("last") + 1).select("track_id", "event_index")
    return slots.join(touched, ["track_id", "event_index"], "left_semi").join(whole, ["track_id", "event_index"], "left_semi")


def validate_annotations(annotations: DataFrame) -> DataFrame:
    """M5: (slot_id, seq, violation): unknown status, a label without word, a word without label."""
    word = F.coalesce(F.trim("word"), F.lit(""))
    checks = {"status": ~F.coalesce(F.col("status").isin(USABLE + BLOCKING + ["pending"]), F.lit(False)), "label without word": F.col("status").isin(USABLE) & (word == ""), "word without label": ~F.col("status").isin(USABLE) & (word != "")}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())
    return annotations.select("slot_id", "seq", F.explode(found).alias("violation"))


def apply_label_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """New words for an event's slots, if the batch has all of them and each reviewed slot's previous word matches.
    current: event, slot_id, word, reviewed; batch: slot_id, previous, word."""
    new = batch.select("slot_id", "previous", F.col("word").alias("new_word"), F.lit(True).alias("given"))
    joined = current.join(new, "slot_id", "left")
    fine = F.coalesce("given", F.lit(False)) & (~F.col("reviewed") | F.col("previous").eqNullSafe(F.col("word")))
    events = joined.groupBy("event").agg(F.bool_and(fine).alias("whole"))
    return joined.join(events, "event").select("event", "slot_id", F.when(F.col("whole"), F.col("new_word")).otherwise(F.col("word")).alias("word"), F.col("whole").alias("applied"))


def resume_queue(old: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """A rebuilt queue with the labels of the old one where every identity column agrees; ``violation`` else."""
    o = old.select("slot_id", F.struct(*identity).alias("o"), F.col("word").alias("old_word"))
    joined = new.select("slot_id", F.struct(*identity).alias("n")).join(o, "slot_id", "full_outer")
    same = F.col("o") == F.col("n")
    violation = F.when(F.col("n").isNull(), "gone").when(F.col("o").isNotNull() & ~same, "changed")
    return joined.select("slot_id", F.when(same, F.col("old_word")).alias("word"), violation.alias("violation"))


def label_audit_queue(suspects: DataFrame, families: DataFrame) -> DataFrame:
    """M6: suspects (slot_id, time_s, human, alt) as form, swap or word; with the range to listen to again."""
    f = lambda c, name: families.select(F.col("word").alias(c), F.col("family").alias(name))
    joined = suspects.join(f("human", "hf"), "human", "left").join(f("alt", "af"), "alt", "left")
    kind = F.when(F.coalesce(F.col("hf") == F.col("af"), F.lit(False)), "form").when(F.col("hf").isNotNull() & F.col("af").isNotNull(), "swap").otherwise("word-or-span")
    return joined.select("slot_id", "human", "alt", kind.alias("kind"), F.greatest(F.col("time_s") - 3, F.lit(0.0)).alias("from_s"), (F.col("time_s") + 3).alias("to_s"))


def review_state(events: DataFrame, current_hash: str) -> DataFrame:
    """M7: the latest review and definition of each id; stale if made under another hash."""
    last = lambda kind, *cols: F.max_by(F.struct(*cols), F.when(F.col("type") == kind, F.col("seq")))
    rows = events.groupBy("id").agg(last("review", "status", "stale_hash").alias("r"), last("custom", "pattern", "target").alias("c"))
    return rows.select("id", F.col("r.status").alias("status"), F.col("c.pattern").alias("pattern"), F.coalesce(F.col("r.stale_hash") != current_hash, F.lit(False)).alias("stale"))


def dangling_references(leads: DataFrame, rows: DataFrame) -> DataFrame:
    """M8: (lead, row_id) that leads cite but rows lack."""
    return leads.select("lead", F.explode("example_ids").alias("row_id")).join(rows.select("row_id"), "row_id", "left_anti").select("lead", "row_id")


def attach_external(slots: DataFrame, external: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """M9: outside transcripts by slot; repeated slots and times that differ are refused (``refused`` tells why)."""
    w = Window.partitionBy("slot_id")
    once = external.withColumn("copies", F.count("*").over(w)).groupBy("slot_id").agg(F.max("copies").alias("copies"), F.min("text").alias("text"), F.min("time_s").alias("other_time"))
    joined = slots.join(once, "slot_id", "left")
    refused = F.when(F.col("copies") > 1, "repeated").when(F.abs(F.col("time_s") - F.col("other_time")) > tolerance, "time")
    return joined.select("slot_id", F.when(refused.isNull(), F.col("text")).alias("text"), refused.alias("refused"))
