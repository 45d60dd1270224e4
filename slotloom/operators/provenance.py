"""Provenance, merging and dataset construction.

Items: id, pair_class, creator, creator_id, report, complete (nullable boolean). Rows: fixture, version, slot,
observation, expected, faithful, source, creator and the like; see each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import clean_metadata, context_key, hash_fold


def classify_pair_kind(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """pair_kind -> pair_class, masked_kind, unmasked_kind from a lookup table; unknown kinds stay null."""
    return items.join(kinds, "pair_kind", "left")


def evidence_status(reports: DataFrame) -> DataFrame:
    """by id: incomplete if any report says so, complete if all say complete, else legacy."""
    done = F.bool_and(F.coalesce("complete", F.lit(False)))
    return reports.groupBy("id").agg(F.when(F.bool_or(~F.col("complete")), "incomplete").when(done, "complete").otherwise("legacy").alias("evidence"))


def provenance_index(items: DataFrame) -> DataFrame:
    """one row an id: its class (conflict if several, unknown if none), its only creator, and whether a report that
    is not incomplete supports the class."""
    rows = items.groupBy("id").agg(F.array_sort(F.collect_set("pair_class")).alias("classes"), F.array_sort(F.collect_set(F.when(clean_metadata("creator") != "", clean_metadata("creator")))).alias("creators"), F.bool_or(F.coalesce("complete", F.lit(True)) & F.col("pair_class").isNotNull()).alias("supported"), F.count_distinct("report").alias("reports"))
    kind = F.when(F.size("classes") > 1, "conflict").when(F.size("classes") == 0, "unknown").otherwise(F.get("classes", F.lit(0)))
    single = F.size("classes") == 1
    return rows.select("id", kind.alias("pair_class"), F.when(F.size("creators") == 1, F.get("creators", F.lit(0))).alias("creator"), "reports", (single & F.col("supported")).alias("eligible"))


def source_groups(items: DataFrame) -> DataFrame:
    """by id: quarantined if classes, creator ids, names (without any id) or declared paths (auto_path, manual_path, if
    there) conflict; status conflict > incomplete > complete > legacy."""
    paths = [F.count_distinct(c).alias(c) for c in ("auto_path", "manual_path") if c in items.columns]
    known = F.when(F.col("pair_class") != "unknown", F.col("pair_class"))
    rows = items.groupBy("id").agg(F.count_distinct(known).alias("nc"), F.count_distinct("creator_id").alias("ni"), F.count_distinct(F.lower("creator")).alias("nn"), F.bool_or(~F.col("complete")).alias("some_open"), F.bool_and(F.coalesce("complete", F.lit(False))).alias("all_done"), *paths)
    clash = (F.col("nc") > 1) | (F.col("ni") > 1) | ((F.col("ni") == 0) & (F.col("nn") > 1))
    for c in ("auto_path", "manual_path"):
        clash = clash | (F.col(c) > 1) if c in items.columns else clash
    status = F.when(clash, "conflict").when(F.coalesce("some_open", F.lit(False)), "incomplete").when(F.col("all_done"), "complete").otherwise("legacy")
    return rows.select("id", status.alias("status"), clash.alias("quarantined"))


def select_version(rows: DataFrame, policy: str = "labeled-rows", preferred: str | None = None) -> DataFrame:
    """the rows of one whole version of each fixture: most faithful rows first, then by policy, then by name."""
    each = rows.groupBy("fixture", "version").agg(F.count_if("faithful").alias("faithful_rows"), F.count("expected").alias("labeled"), F.count("*").alias("n"), F.bool_or(F.col("source") == (preferred or "")).alias("is_preferred"))
    keys = [F.desc("labeled"), F.desc("n")] if policy == "labeled-rows" else [F.desc("is_preferred"), F.desc("n")]
    w = Window.partitionBy("fixture").orderBy(F.desc("faithful_rows"), *keys, "version")
    best = each.withColumn("k", F.row_number().over(w)).where("k = 1").select("fixture", "version")
    return rows.join(best, ["fixture", "version"], "left_semi")


def slot_conflicts(rows: DataFrame) -> DataFrame:
    """by fixture and slot the number of different observations and of exact repeats."""
    each = rows.groupBy("fixture", "slot").agg(F.count_distinct("observation").alias("observations"), F.count("*").alias("n"))
    return each.select("fixture", "slot", "observations", (F.col("n") - F.col("observations")).alias("repeats"), (F.col("observations") > 1).alias("conflict"))


def merge_rows(archive: DataFrame, local: DataFrame) -> DataFrame:
    """one row a (fixture, slot) of both tables: faithful before not, local before archive; sources are united and
    labels that differ marked."""
    both = archive.withColumn("origin", F.lit("archive")).unionByName(local.withColumn("origin", F.lit("local")), allowMissingColumns=True)
    w = Window.partitionBy("fixture", "slot")
    order = w.orderBy(F.desc(F.col("faithful").cast("int")), F.desc("origin"), "version")
    ranked = both.withColumn("k", F.row_number().over(order)).withColumn("sources", F.array_sort(F.collect_set("source").over(w))).withColumn("lo", F.min("expected").over(w)).withColumn("hi", F.max("expected").over(w))
    return ranked.where("k = 1").withColumn("label_conflict", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).drop("k", "lo", "hi", "source")


def merge_overlap(archive: DataFrame, local: DataFrame) -> DataFrame:
    """counts of shared observations, shared slots and slots of just one table."""
    a, b = archive.select("fixture", "slot", "observation").distinct(), local.select("fixture", "slot", "observation").distinct()
    shared = a.intersect(b).agg(F.count("*").alias("same_observation"))
    slots = a.select("fixture", "slot").distinct().withColumn("a", F.lit(1)).join(b.select("fixture", "slot").distinct().withColumn("b", F.lit(1)), ["fixture", "slot"], "full_outer")
    return slots.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same_slot"), F.count_if(F.col("b").isNull()).alias("only_archive"), F.count_if(F.col("a").isNull()).alias("only_local")).join(shared, F.lit(True))


def resolve_creator(rows: DataFrame) -> DataFrame:
    """F8: a valid id stands; else the only id seen for the name; several -> ambiguous, none -> unknown."""
    ids = rows.where("creator_id IS NOT NULL").groupBy("creator").agg(F.array_sort(F.collect_set("creator_id")).alias("ids"))
    joined = rows.join(ids, "creator", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    key = F.coalesce("creator_id", F.when(n == 1, F.get("ids", F.lit(0))))
    status = F.when(F.col("creator_id").isNotNull(), "given").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unknown")
    return joined.withColumn("creator_key", key).withColumn("creator_status", status).drop("ids")


def exclusion_reason(rows: DataFrame) -> DataFrame:
    """the first reason that keeps a row out of a labelled dataset; null for rows that stay."""
    reason = (
        F.when(~F.coalesce("complete", F.lit(False)), "incomplete").when(F.size("labels") == 0, "unlabelled").when(F.size("labels") > 1, "multi-label").when(F.col("pair_class").isin("conflict", "unknown"), "invalid")
        .when(F.col("creator_status") == "unknown", "unknown creator").when(F.col("creator_status") == "ambiguous", "ambiguous creator").when(F.coalesce(F.trim("context"), F.lit("")) == "", "invalid context")
    )
    return rows.withColumn("reason", reason)


def build_labeled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, counts by reason with ``kept``)."""
    flagged = exclusion_reason(rows)
    return flagged.where("reason IS NULL").drop("reason"), flagged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def creator_groups(rows: DataFrame, folds: int = 5) -> DataFrame:
    """rows, fixtures and fold of each creator."""
    return rows.groupBy("creator_key").agg(F.count("*").alias("rows"), F.count_distinct("fixture").alias("fixtures")).withColumn("fold", hash_fold("creator_key", folds))


def context_leakage(rows: DataFrame, folds: int = 5) -> DataFrame:
    """contexts that come up with several creators or in several folds."""
    keyed = rows.select(context_key("context").alias("context_key"), "creator_key", hash_fold("creator_key", folds).alias("fold"))
    return keyed.groupBy("context_key").agg(F.count("*").alias("n"), F.count_distinct("creator_key").alias("creators"), F.count_distinct("fold").alias("folds")).where("creators > 1")


def duplicate_diagnostics(rows: DataFrame) -> DataFrame:
    """input, retained, repeated and conflicting rows."""
    each = slot_conflicts(rows)
    return each.agg(F.sum(F.col("observations") + F.col("repeats")).alias("input"), F.count("*").alias("retained"), F.sum("repeats").alias("repeats"), F.count_if("conflict").alias("conflicts"))


def assign_split(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """split by id and by name; if both and different: conflict; if none: unknown."""
    by_id = manifest.where("creator_id IS NOT NULL").select("creator_id", F.col("split").alias("s_id"))
    by_name = manifest.select(F.lower("name").alias("name_key"), F.col("split").alias("s_name"))
    joined = rows.withColumn("name_key", F.lower("creator")).join(by_id, "creator_id", "left").join(by_name, "name_key", "left")
    split = F.when((F.col("s_id") != F.col("s_name")), "conflict").otherwise(F.coalesce("s_id", "s_name", F.lit("unknown")))
    return joined.withColumn("split", split).drop("s_id", "s_name", "name_key")


def validate_manifest(manifest: DataFrame) -> DataFrame:
    """(name, violation): repeated names or ids, invalid split, test creators without id, frozen in the future."""
    checks = {"split": ~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)), "test without id": (F.col("split") == "test") & F.col("creator_id").isNull(), "frozen later": F.col("frozen_at") > F.current_timestamp()}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())
    rows = manifest.select("name", F.explode(found).alias("violation"))
    names = manifest.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("repeated name").alias("violation"))
    ids = manifest.where("creator_id IS NOT NULL").groupBy("creator_id").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1").select("name", F.lit("repeated id").alias("violation"))
    return rows.unionByName(names).unionByName(ids)


def prospective_minimums(rows: DataFrame, creators: int, slots: int) -> DataFrame:
    """whether each split has enough creators and slots."""
    each = rows.groupBy("split").agg(F.count_distinct("creator_key").alias("creators"), F.sum("slots").alias("slots"))
    return each.withColumn("enough", (F.col("creators") >= creators) & (F.col("slots") >= slots))


def exclude_heldout(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """F16: rows whose id is not held out."""
    return rows.join(ids.select(key), key, "left_anti")


def build_discovery(direct: DataFrame, aligned: DataFrame, groups: DataFrame) -> DataFrame:
    """slots with a label from direct pairs, else aligned, else unknown; slots of quarantined ids stay unlabelled.
    direct, aligned: id, token_index, expected (direct holds all slots)."""
    joined = direct.join(aligned.select("id", "token_index", F.col("expected").alias("other")), ["id", "token_index"], "left").join(groups.select("id", "quarantined"), "id", "left")
    free = ~F.coalesce("quarantined", F.lit(False))
    label = F.when(free, F.coalesce("expected", "other"))
    return joined.select("id", "token_index", label.alias("expected"), F.when(label.isNull(), "unknown").when(F.col("expected").isNotNull(), "direct").otherwise("aligned").alias("label_source"))


def index_by_word(rows: DataFrame) -> DataFrame:
    """the index from tier and word to row ids: one row an id, clustered and ordered by key, so that no word's ids
    have to fit in one row or task."""
    return rows.select("tier", "expected", "row_id").repartitionByRange("tier", "expected", "row_id").sortWithinPartitions("tier", "expected", "row_id")


def index_by_shape(rows: DataFrame) -> DataFrame:
    """the index from context shape and slot offset to row ids, laid out like ``index_by_word``."""
    return rows.select("shape", "slot_index", "row_id").repartitionByRange("shape", "slot_index", "row_id").sortWithinPartitions("shape", "slot_index", "row_id")
