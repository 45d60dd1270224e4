"""Acquisition analytics over ledgers of items and status events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_summary(items: DataFrame) -> DataFrame:
    """Saved items and slots by class."""
    return items.groupBy("pair_class").agg(F.count("*").alias("items"), F.sum("slots").alias("slots"))


def check_ledger(events: DataFrame, negative: list[str]) -> DataFrame:
    """The latest negative status of each (id, check type); later positive ones clear it."""
    last = events.groupBy("id", "check_type").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    return last.where(F.col("status").isin(negative))


def to_check(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """Work (id, check_type) without those that the ledger has settled."""
    return work.join(ledger.select("id", "check_type"), ["id", "check_type"], "left_anti")


def abandoned(events: DataFrame, transient: list[str], times: int = 3) -> DataFrame:
    """Ids with so many transient failures."""
    return events.where(F.col("status").isin(transient)).groupBy("id").agg(F.count("*").alias("failures")).where(F.col("failures") >= times)


def budget_met(channels: DataFrame) -> DataFrame:
    """Why a channel is finished, or null. channels: id, available, saved, target, checked, most, slots, cap, open."""
    why = F.when(~F.col("available"), "unavailable").when(F.col("saved") >= F.col("target"), "target").when(F.col("checked") >= F.col("most"), "checked").when(F.col("slots") >= 0.99 * F.col("cap"), "slots").when(F.col("open") == 0, "settled")
    return channels.withColumn("finished", why)


def validate_channels(channels: DataFrame) -> DataFrame:
    """(name, violation): repeated names or ids, no sources, prospective without id."""
    checks = {"no sources": F.coalesce(F.size("sources"), F.lit(0)) <= 0, "prospective without id": F.coalesce("prospective", F.lit(False)) & F.col("channel_id").isNull()}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())
    rows = channels.select("name", F.explode(found).alias("violation"))
    names = channels.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("repeated name").alias("violation"))
    ids = channels.where("channel_id IS NOT NULL").groupBy("channel_id").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1").select("name", F.lit("repeated id").alias("violation"))
    return rows.unionByName(names).unionByName(ids)


def refresh_decision(state: DataFrame, now: DataFrame, least: int) -> DataFrame:
    """By source whether to refresh: enough new slots or a complete queue, evidence not incomplete, inputs changed."""
    joined = now.join(state.select("source", F.col("slots").alias("old_slots"), F.col("fingerprint").alias("old_fp")), "source", "left")
    gained = F.col("slots") - F.coalesce("old_slots", F.lit(0))
    go = ((gained >= least) | F.col("queue_complete")) & (F.col("evidence") != "incomplete") & ~F.col("fingerprint").eqNullSafe(F.col("old_fp"))
    return joined.select("source", gained.alias("gained"), go.alias("refresh"))


def acquire_status(items: DataFrame) -> DataFrame:
    """The ordered outcome of an item from observed facts."""
    status = F.when(F.col("exists"), "existing").when(~F.col("has_manual"), "no-manual").when(~F.col("has_automatic"), "no-automatic").when(F.col("masked_already"), "already-masked").when(F.col("slots") == 0, "no-slots").when(F.col("slots") > F.col("cap"), "cap").otherwise("saved")
    return items.withColumn("status", status)
