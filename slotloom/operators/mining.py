"""Pattern mining: conditions around slots, their statistics, gates, cross-validation, and class patterns.

Rows have row_id, creator, fold, tier, expected (null: unknown), predicted (null: none) and features, an array of
(off, tok). A leaf is a set of conditions; its key is the conditions' ``off=tok`` joined by ``&`` in order of offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import rate, wilson_lower
from slotloom.operators.greedy import Gate, creator_gate, gated_hits, greedy_select
from slotloom.sources.scratch import cut

__all__ = ["Gate", "creator_gate", "gated_hits", "greedy_select"]

SUPPORT, PRECISION, CREATORS, MARGINAL_SUPPORT, MARGINAL_PRECISION = 4, 0.92, 2, 3, 0.92


def _conditions(features: Column | str) -> Column:
    """struct<one, lefts, rights>: a row's single conditions in order of offset, how many stand before the slot and after it."""
    f = F.array_sort(features)
    one = F.transform(f, lambda c: F.concat(c["off"].cast("string"), F.lit("="), c["tok"]))
    return F.struct(one.alias("one"), F.size(F.filter(features, lambda c: c["off"] < 0)).alias("lefts"), F.size(F.filter(features, lambda c: c["off"] > 0)).alias("rights"))


def _keys(one: Column, lefts: Column, rights: Column, depth: int, phrase: int) -> Column:
    pairs = F.flatten(F.transform(one, lambda a, i: F.transform(F.slice(one, i + 2, F.greatest(F.size(one) - i - 1, F.lit(0))), lambda b: F.concat(a, F.lit("&"), b))))
    # A phrase is the last a tokens before the slot and the first b after it.
    spans = F.flatten(F.transform(F.sequence(F.lit(0), lefts), lambda a: F.transform(F.sequence(F.lit(0), rights), lambda b: F.when((a + b > 2) & (a + b <= phrase), F.array_join(F.slice(one, lefts - a + 1, a + b), "&")))))
    keys = one if depth < 2 else F.concat(one, pairs)
    return F.array_distinct(F.concat(keys, F.filter(spans, lambda s: s.isNotNull())))


def condition_keys(features: Column | str, depth: int = 2, phrase: int = 8) -> Column:
    """H3: array of leaf keys: every single condition, every pair, and the phrases that touch the slot."""
    c = _conditions(features)
    return _keys(c["one"], c["lefts"], c["rights"], depth, phrase)


def row_conditions(rows: DataFrame, depth: int = 2, phrase: int = 8) -> DataFrame:
    """Rows exploded to their leaf keys."""
    keep = [c for c in rows.columns if c != "features"]
    # explode over one element: the conditions are sorted and written once a row, not anew for each pair and phrase
    held = rows.select(*keep, F.explode(F.array(_conditions("features"))).alias("__c"))
    return held.select(*keep, F.explode(_keys(F.col("__c.one"), F.col("__c.lefts"), F.col("__c.rights"), depth, phrase)).alias("leaf_key"))


def prune_by_support(keyed: DataFrame, support: int = SUPPORT) -> DataFrame:
    """H4: only keys seen often enough; counted before any detail is built."""
    often = keyed.groupBy("leaf_key").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("leaf_key")
    return keyed.join(often, "leaf_key", "left_semi")


def leaf_counts(rows: DataFrame, *by: str, depth: int = 2, phrase: int = 8, support: int = SUPPORT) -> DataFrame:
    """The rows of each leaf that H4 keeps, added up by ``by``, creator and label (null: unknown): n, open (without a prediction)
    and right. All of H5, H13 and H14 is made from this one pass; keys are counted before they are shuffled, so a key that
    nearly all rows have sends its counts only. Written once."""
    keyed = row_conditions(rows.select(*by, "creator", "expected", "predicted", "features"), depth, phrase)
    right = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    counts = cut(keyed.groupBy("leaf_key", *by, "creator", "expected").agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNull()).alias("open"), F.count_if(right).alias("right")), "leaf-counts")
    often = counts.groupBy("leaf_key").agg(F.sum("n").alias("all")).where(F.col("all") >= support).select("leaf_key")
    return counts.join(often, "leaf_key", "left_semi")


def _top_labels(counts: DataFrame, creators: DataFrame, *by: str) -> DataFrame:
    """Each leaf's most frequent label from counts by label (n, open, right)."""
    group = Window.partitionBy(*by, "leaf_key")
    w = group.orderBy(F.desc("n"), "expected")
    ranked = counts.withColumn("support", F.sum("n").over(group)).withColumn("marginal_support", F.sum("open").over(group)).withColumn("now_right", F.sum("right").over(group)).withColumn("k", F.row_number().over(w))
    top = ranked.where("k = 1").select(*by, "leaf_key", F.col("expected").alias("target"), "support", F.col("n").alias("target_count"), (F.col("n") / F.col("support")).alias("precision"), "marginal_support", F.col("open").alias("marginal_correct"), rate("open", "marginal_support").alias("marginal_precision"), (F.col("n") - F.col("now_right")).alias("gain"))
    return top.join(creators, [*by, "leaf_key"])


def leaf_stats(keyed: DataFrame, *by: str) -> DataFrame:
    """H5: each leaf's support, top label, precision, and what it would add to the present predictions."""
    right = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    counts = keyed.where("expected IS NOT NULL").groupBy(*by, "leaf_key", "creator", "expected").agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNull()).alias("open"), F.count_if(right).alias("right"))
    return counted_stats(counts, *by)


def counted_stats(counts: DataFrame, *by: str) -> DataFrame:
    """H5 from ``leaf_counts``."""
    known = counts.where("expected IS NOT NULL")
    words = known.groupBy(*by, "leaf_key", "expected").agg(*[F.sum(c).alias(c) for c in ("n", "open", "right")])
    return _top_labels(words, known.groupBy(*by, "leaf_key").agg(F.count_distinct("creator").alias("creators")), *by)


def fold_stats(counts: DataFrame, folds: int) -> DataFrame:
    """H5 for each held-out fold over all others. A creator is in one fold, so what the others have is the total less the
    fold's own: counts and creators are made once a leaf, never once a fold. counts: ``leaf_counts`` by fold."""
    known = counts.where("expected IS NOT NULL")
    apart = lambda c, f: F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0))
    words = known.groupBy("leaf_key", "expected").agg(*[F.sum(c).alias(c) for c in ("n", "open", "right")], *[F.array(*[apart(c, f) for f in range(folds)]).alias(f"{c}_of") for c in ("n", "open", "right")])
    people = known.select("leaf_key", "fold", "creator").distinct().where(F.col("creator").isNotNull()).groupBy("leaf_key").agg(F.count("*").alias("creators"), F.array(*[F.count_if(F.col("fold") == f) for f in range(folds)]).alias("creators_of"))
    held = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")
    less = lambda c: (F.col(c) - F.get(f"{c}_of", F.col("held"))).alias(c)
    words = words.select("*", held).select("held", "leaf_key", "expected", less("n"), less("open"), less("right")).where("n > 0")
    return _top_labels(words, people.select("*", held).select("held", "leaf_key", less("creators")), "held")


def depth_of(leaf_key: Column | str) -> Column:
    return F.size(F.split(leaf_key, "&"))


def qualify_leaves(stats: DataFrame) -> DataFrame:
    """H6: the leaves that pass all gates, with their rank by depth, gain, precision, support."""
    good = stats.where((F.col("support") >= SUPPORT) & (F.col("creators") >= CREATORS) & (F.col("precision") >= PRECISION) & (F.col("marginal_support") >= MARGINAL_SUPPORT) & (F.col("marginal_precision") >= MARGINAL_PRECISION) & (F.col("gain") >= 1))
    return good.withColumn("depth", depth_of("leaf_key"))


def rank_key() -> list[Column]:
    return [F.col("depth"), F.desc("gain"), F.desc("precision"), F.desc("support"), F.col("leaf_key")]


def support_units(keyed: DataFrame, *by: str) -> DataFrame:
    """H7: rows collapsed to (creator, context, slot); a unit is clean if it has one label and nothing unknown."""
    units = keyed.groupBy(*by, "leaf_key", "creator", "context_id", "slot_index").agg(F.collect_set("expected").alias("labels"), F.bool_or(F.col("expected").isNull()).alias("unknown"), F.max("predicted").alias("predicted"))
    return units.withColumn("label", F.when((F.size("labels") == 1) & ~F.col("unknown"), F.get("labels", F.lit(0)))).drop("labels")


def discovery_leads(units: DataFrame, *by: str, support: int = SUPPORT, creators: int = CREATORS, precision: float = PRECISION) -> DataFrame:
    """H8: each leaf's top label over units; unknown and conflicting units stay in the denominator. ``reasons`` lists the
    gates that fail."""
    group = [*by, "leaf_key"]
    counts = units.groupBy(*group, "label").agg(F.count("*").alias("n"), F.count_distinct("creator").alias("own_creators"), F.count_if(F.col("predicted").isNull()).alias("open"), F.count_if(F.col("predicted") == F.col("label")).alias("right"))
    w = Window.partitionBy(*group)
    ranked = counts.withColumn("units", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.col("label").isNull().cast("int"), F.desc("n"), "label"))).where("k = 1 AND label IS NOT NULL")
    lead = ranked.select(*group, F.col("label").alias("target"), "units", F.col("n").alias("target_count"), (F.col("n") / F.col("units")).alias("precision"), F.col("own_creators").alias("creators"), F.col("open").alias("marginal_correct"), (F.col("n") - F.col("right")).alias("gain"))
    reasons = F.filter(F.array(F.when(F.col("target_count") < support, "support"), F.when(F.col("creators") < creators, "creators"), F.when(F.col("precision") < precision, "precision"), F.when(F.col("gain") < 1, "gain")), lambda r: r.isNotNull())
    return lead.withColumn("reasons", reasons)


def rejections(leads: DataFrame, samples: int = 10) -> DataFrame:
    """H9: leads by failed gate with some examples each."""
    rows = leads.select("leaf_key", "target_count", F.explode("reasons").alias("reason"))
    w = Window.partitionBy("reason").orderBy(F.desc("target_count"), "leaf_key")
    top = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples)
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(top.groupBy("reason").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "leaf_key"))), lambda s: s["leaf_key"]).alias("samples")), "reason")


def cross_tier_audit(leads: DataFrame, other: DataFrame) -> DataFrame:
    """The same leaves in the other tier; ``veto`` where it is well supported there for another word."""
    o = other.select("leaf_key", F.col("target").alias("other_target"), F.col("units").alias("other_units"), F.col("precision").alias("other_precision"))
    joined = leads.join(o, "leaf_key", "left")
    veto = (F.col("other_target") != F.col("target")) & (F.col("other_units") >= SUPPORT) & (F.col("other_precision") >= PRECISION)
    return joined.withColumn("veto", F.coalesce(veto, F.lit(False)))


def word_summary(units: DataFrame) -> DataFrame:
    """By word its clean units, creators, and the units of the same leaf with another or no label."""
    per = units.groupBy("leaf_key").agg(F.count("*").alias("all"), F.count_if(F.col("label").isNull()).alias("unknown"))
    clean = units.where("label IS NOT NULL").groupBy("label", "leaf_key").agg(F.count("*").alias("n")).join(per, "leaf_key")
    people = units.where("label IS NOT NULL").groupBy("label").agg(F.count_distinct("creator").alias("creators"))
    return clean.groupBy("label").agg(F.sum("n").alias("clean"), F.sum("unknown").alias("unknown"), F.sum(F.col("all") - F.col("n") - F.col("unknown")).alias("competing")).join(people, "label")


def apply_leaves(keyed: DataFrame, leaves: DataFrame, *by: str) -> DataFrame:
    """The best-ranked leaf of each row overrides its prediction. keyed: rows with leaf_key; leaves: qualified."""
    hits = keyed.join(leaves.select(*by, "leaf_key", "target", "depth", "gain", "precision", "support"), [*by, "leaf_key"])
    best = hits.groupBy(*by, "row_id").agg(F.min_by("target", F.struct("depth", -F.col("gain"), -F.col("precision"), -F.col("support"), "leaf_key")).alias("override"))
    return best


def with_overrides(rows: DataFrame, best: DataFrame, *by: str) -> DataFrame:
    joined = rows.join(best, [*by, "row_id"], "left")
    return joined.withColumn("model", F.coalesce("override", "predicted")).drop("override")


def model_metrics(applied: DataFrame, *by: str) -> DataFrame:
    """Counts of what the overrides change, with precision and coverage of the whole."""
    ok = lambda c: F.coalesce(F.col(c) == F.col("expected"), F.lit(False))
    out = (applied.groupBy(*by) if by else applied).agg(F.count("*").alias("slots"), F.count_if(~F.col("model").eqNullSafe(F.col("predicted"))).alias("changed"), F.count_if(F.col("model").isNotNull()).alias("attempted"), F.count_if(ok("model")).alias("correct"), F.count_if(ok("predicted")).alias("baseline_correct"))
    return out.withColumn("precision", rate("correct", "attempted")).withColumn("coverage", rate("correct", "slots"))


def creator_fold_cv(rows: DataFrame, folds: int, depth: int = 2) -> DataFrame:
    """For each held-out fold learn leaves on the rest and apply them to it; one job for all folds."""
    leaves = cut(qualify_leaves(fold_stats(leaf_counts(rows, "fold", depth=depth), folds)), "leaves")
    own = rows.withColumn("held", F.col("fold"))
    best = apply_leaves(row_conditions(own.select("row_id", "held", "features"), depth), leaves, "held")
    return model_metrics(with_overrides(own, best, "held"), "held")


def proposals(rows: DataFrame, folds: int, depth: int = 2, least: float = 0.9, limit: int = 100) -> DataFrame:
    """Leaves that qualify in every fold's training part, with their held-out precision; best first."""
    counts = leaf_counts(rows, "fold", depth=depth)
    leaves = qualify_leaves(fold_stats(counts, folds))
    stable = leaves.groupBy("leaf_key", "target").agg(F.count("*").alias("folds")).where(F.col("folds") == folds)
    checked = counts.join(stable, "leaf_key").groupBy("leaf_key", "target").agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("expected") == F.col("target"), F.col("n"))), F.lit(0)).alias("correct"))
    good = checked.withColumn("precision", F.col("correct") / F.col("support")).where(F.col("precision") >= least)
    return good.orderBy(F.desc("correct"), F.desc("precision"), "leaf_key").limit(limit)


def promotion_eligible(datasets: DataFrame) -> DataFrame:
    """Only faithful labelled data under the current evidence policy may yield proposals."""
    return datasets.withColumn("eligible", ~F.coalesce("discovery_only", F.lit(True)) & F.coalesce("context_faithful", F.lit(False)) & (F.col("policy") == "current"))


def transfer_audit(proposed: DataFrame, keyed: DataFrame) -> DataFrame:
    """Each proposal on the other tier's rows: support, precision, dominant label and whether it is reversed."""
    hits = keyed.join(proposed.select("leaf_key", "target"), "leaf_key").where("expected IS NOT NULL")
    counts = hits.groupBy("leaf_key", "target", "expected").agg(F.count("*").alias("n"))
    w = Window.partitionBy("leaf_key")
    top = counts.withColumn("support", F.sum("n").over(w)).withColumn("hit", F.sum(F.when(F.col("expected") == F.col("target"), F.col("n")).otherwise(0)).over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "expected"))).where("k = 1")
    reversed_ = (F.col("expected") != F.col("target")) & (F.col("support") >= SUPPORT) & (F.col("n") / F.col("support") >= PRECISION)
    return top.select("leaf_key", "target", "support", (F.col("hit") / F.col("support")).alias("precision"), F.col("expected").alias("dominant"), reversed_.alias("reversed"))


def render_pattern(leaf_key: Column | str, slot: str = "[_]") -> Column:
    """A leaf as a template with ``*`` in gaps; null if it binds a text boundary or a token that is no word."""
    key = F.col(leaf_key) if isinstance(leaf_key, str) else leaf_key
    parts = F.transform(F.split(key, "&"), lambda c: F.struct(F.regexp_extract(c, "^(-?[0-9]+)=", 1).cast("int").alias("off"), F.regexp_replace(c, "^-?[0-9]+=", "").alias("tok")))
    offs = F.transform(parts, lambda p: p["off"])
    lo, hi = F.least(F.array_min(offs), F.lit(0)), F.greatest(F.array_max(offs), F.lit(0))
    words = F.transform(F.sequence(lo, hi), lambda o: F.when(o == 0, slot).otherwise(F.coalesce(F.get(F.filter(parts, lambda p: p["off"] == o), F.lit(0))["tok"], F.lit("*"))))
    plain = F.forall(parts, lambda p: p["tok"].rlike(r"^[\p{L}\p{N}_']+$"))
    return F.when(plain, F.array_join(words, " "))


def preview_pattern(keyed: DataFrame, leaf_key: str, target: str) -> DataFrame:
    """By tier how many rows of a leaf speak for a word, against it, or are unknown."""
    hits = keyed.where(F.col("leaf_key") == leaf_key)
    return hits.groupBy("tier").agg(F.count_if(F.col("expected") == target).alias("positive"), F.count_if(F.col("expected") != target).alias("counter"), F.count_if(F.col("expected").isNull()).alias("unknown"))


def class_tag(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """Tokens with their word class from a (tok, cls) table; unknown words have none."""
    return tokens.join(classes, "tok", "left")


#: Tokens of a task of H19. Each slot becomes up to 48 patterns, which the task's first sums and sorts hold.
TOKENS = 1 << 17


def class_patterns(tagged: DataFrame) -> DataFrame:
    """Every choice of literal or class for no, one or two tokens on each side of a slot, one token at least; text
    boundaries are no tokens. tagged: row_id, off from -2 to 2, tok, cls; a slot's (at most four) tokens meet in one row.
    Slots are dealt to a counted number of tasks, for sizes before patterns are made do not tell how many there will be."""
    words = tagged.where(F.col("off").between(-2, 2) & ~F.col("tok").isin("<BOS>", "<EOS>"))
    least = tagged.sparkSession.sparkContext.defaultParallelism
    words = words.repartition(max(least, -(-words.count() // TOKENS)), "row_id")
    choice = F.array_distinct(F.filter(F.array(F.col("tok"), F.concat(F.lit("<"), "cls", F.lit(">"))), lambda x: x.isNotNull()))
    rows = words.groupBy("row_id").agg(*[F.coalesce(F.max(F.when(F.col("off") == o, choice)), F.array().cast("array<string>")).alias(n) for o, n in ((-2, "a"), (-1, "b"), (1, "c"), (2, "d"))])
    two = lambda p, q: F.flatten(F.transform(p, lambda x: F.transform(q, lambda y: F.concat_ws(" ", x, y))))
    lefts, rights = F.concat(F.array(F.lit("")), "b", two("a", "b")), F.concat(F.array(F.lit("")), "c", two("c", "d"))
    sides = rows.select("row_id", F.explode(lefts).alias("l"), rights.alias("rights")).select("row_id", "l", F.explode("rights").alias("r"))
    return sides.where("l <> '' OR r <> ''").select("row_id", F.trim(F.concat_ws(" [] ", "l", "r")).alias("pattern"))


def induce_classes(tagged: DataFrame, times: int = 3, share: float = 0.9) -> DataFrame:
    """Words seen often enough and nearly always in one class. tagged: tok, cls."""
    counts = tagged.where("cls IS NOT NULL").groupBy("tok", "cls").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tok")
    return counts.withColumn("total", F.sum("n").over(w)).where((F.col("total") >= times) & (F.col("n") / F.col("total") >= share)).select("tok", "cls", F.col("n"), "total")


def word_choice(patterns: DataFrame, times: int = 5, share: float = 0.92, creators: int = 2, lower: float = 0.8, tier: str = "manual") -> DataFrame:
    """By pattern, fold and tier the top word of the labelled rows and whether it passes the gate. In ``tier`` the
    lower bound of its share must also reach ``lower``, and the other tiers, where they have ``times`` rows of the
    pattern, must not contradict it. patterns: pattern, half, tier, expected, creator."""
    keys = ["pattern", "half", "tier"]
    counts = patterns.where("expected IS NOT NULL").groupBy(*keys, "expected").agg(F.count("*").alias("n"), F.count_distinct("creator").alias("creators"))
    # All windows find the partitioning of the first one.
    both, w, elsewhere = Window.partitionBy("pattern", "half"), Window.partitionBy(*keys), F.when(F.col("tier") != tier, F.col("n")).otherwise(0)
    counts = counts.withColumn("other", F.sum(elsewhere).over(both)).withColumn("other_n", F.sum(elsewhere).over(Window.partitionBy("pattern", "half", "expected")))
    top = counts.withColumn("total", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "expected"))).where("k = 1")
    sure = (wilson_lower("n", "total") >= lower) & ((F.col("other") < times) | (F.col("other_n") / F.col("other") >= share))
    ok = (F.col("total") >= times) & (F.col("n") / F.col("total") >= share) & (F.col("creators") >= creators) & ((F.col("tier") != tier) | F.coalesce(sure, F.lit(False)))
    return top.select(*keys, F.col("expected").alias("word"), "n", "total", "creators", ok.alias("passes"))


def two_fold_gate(choices: DataFrame) -> DataFrame:
    """Patterns whose word passes in both halves of a tier and is the same there."""
    good = choices.where("passes")
    return good.groupBy("pattern", "tier").agg(F.count_distinct("half").alias("halves"), F.count_distinct("word").alias("words"), F.min("word").alias("word"), F.sum("n").alias("n")).where("halves = 2 AND words = 1").select("pattern", "tier", "word", "n")


def emit_templates(selected: DataFrame, existing: DataFrame) -> DataFrame:
    """Selected patterns as templates, without those that hold something else than words or classes, or exist."""
    plain = selected.where(F.forall(F.split("pattern", " "), lambda t: t.rlike(r"^(\[\]|<[a-z]+>|[\p{L}\p{N}_']+)$")))
    return plain.select(F.replace("pattern", F.lit("[]"), F.concat(F.lit("["), "word", F.lit("]"))).alias("template"), "word").dropDuplicates(["template"]).join(existing.select("template"), "template", "left_anti")


def train_only_check(tagged: DataFrame, rows: DataFrame, both_sides: bool = True, lower: float = 0.0) -> DataFrame:
    """Classes induced anew on each half, patterns matched in the other half. tagged: row_id, half, off, tok, cls;
    rows: row_id, half, tier, expected, creator. both_sides: only patterns with a token on each side; lower: H21's bound."""
    out = None
    for half in (0, 1):
        classes = induce_classes(tagged.where(F.col("half") == half)).select("tok", "cls")
        other = class_tag(tagged.where(F.col("half") != half).drop("cls"), classes)
        patterns = class_patterns(other)
        patterns = patterns.where("pattern LIKE '% [] %'") if both_sides else patterns
        part = word_choice(patterns.join(rows, "row_id"), lower=lower).withColumn("trained_on", F.lit(half))
        out = part if out is None else out.unionByName(part)
    return out
