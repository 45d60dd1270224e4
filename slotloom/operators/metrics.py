"""Aggregations and metrics over predictions.

A prediction row has track_id, token_index, creator, pair_class, expected (null: not scored), word (null: not
attempted), candidates and rule_id. Precision = correct / attempted among scored slots, coverage = correct / scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import rate, stable_id, wilson_lower


def with_flags(predictions: DataFrame) -> DataFrame:
    scored = F.col("expected").isNotNull()
    attempted = scored & F.col("word").isNotNull()
    return predictions.withColumn("is_scored", scored).withColumn("is_attempted", attempted).withColumn("is_correct", F.coalesce(attempted & (F.col("word") == F.col("expected")), F.lit(False)))


def totals() -> list[Column]:
    return [F.count("*").alias("slots"), F.count_if("is_scored").alias("scored"), F.count_if("is_attempted").alias("attempted"), F.count_if("is_correct").alias("correct")]


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumn("precision", rate("correct", "attempted")).withColumn("coverage", rate("correct", "scored"))


def summarize(predictions: DataFrame, *by: str) -> DataFrame:
    """Counts, precision and coverage of all or of each group."""
    flagged = with_flags(predictions)
    return with_rates((flagged.groupBy(*by) if by else flagged).agg(*totals()))


def by_sets(predictions: DataFrame, *columns: str) -> DataFrame:
    """Totals and each column alone, in one pass over grouping sets; ``dimension`` names the column."""
    flagged = with_flags(predictions)
    sets = [[]] + [[F.col(c)] for c in columns]
    grouped = flagged.groupingSets(sets, *map(F.col, columns)).agg(*totals(), F.grouping_id().alias("gid"))
    names = {2 ** len(columns) - 1: "all"} | {(2 ** len(columns) - 1) ^ (1 << (len(columns) - 1 - i)): c for i, c in enumerate(columns)}
    name = F.coalesce(*[F.when(F.col("gid") == g, n) for g, n in names.items()])
    value = F.coalesce(*[F.when(F.col("gid") == g, F.col(n)) for g, n in names.items() if n != "all"])
    return with_rates(grouped.select(name.alias("dimension"), value.alias("value"), "slots", "scored", "attempted", "correct"))


def creator_macro(predictions: DataFrame, *by: str) -> DataFrame:
    """Means over creators of precision (attempted > 0) and coverage (scored > 0); unknown creators do not count."""
    each = summarize(predictions.where("creator IS NOT NULL"), *by, "creator")
    return (each.groupBy(*by) if by else each).agg(F.avg("precision").alias("macro_precision"), F.avg("coverage").alias("macro_coverage"), F.count("*").alias("creators"))


def rule_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """Each rule's matches, attempts, hits, slots where any candidate is right, and its creators; also by class (``by``)."""
    rows = with_flags(predictions.where("rule_id IS NOT NULL"))
    any_right = F.coalesce(F.array_contains("candidates", F.col("expected")), F.lit(False))
    return rows.groupBy("rule_id", *by).agg(F.count("*").alias("matched"), F.count_if("is_attempted").alias("attempted"), F.count_if("is_correct").alias("correct"), F.count_if(any_right).alias("candidate_correct"), F.max(F.size("candidates")).alias("max_candidates"), F.count_distinct("creator").alias("creators"))


def quality_gate(rules: DataFrame, least_precision: float = 0.9, support: int = 4, creators: int = 2) -> DataFrame:
    """Pass, or the first gate that fails, by support, creators and precision; several candidates need more."""
    precision = rate("correct", "attempted")
    need = F.when(F.col("max_candidates") > 1, support * 2).otherwise(support)
    verdict = F.when(F.col("matched") < need, "support").when(F.col("creators") < creators, "creators").when(F.coalesce(precision, F.lit(0.0)) < least_precision, "precision").otherwise("pass")
    return rules.withColumn("verdict", verdict)


def classify(predictions: DataFrame) -> DataFrame:
    """Unscored, correct, different or missed."""
    kind = F.when(F.col("expected").isNull(), "unscored").when(F.col("word").isNull(), "missed").when(F.col("word") == F.col("expected"), "correct").otherwise("different")
    return predictions.withColumn("classification", kind)


def top_confusions(predictions: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent wrong pairs, ties by expected, then predicted."""
    wrong = classify(predictions).where("classification = 'different'")
    return wrong.groupBy("expected", F.col("word").alias("predicted")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "predicted").limit(k)


def track_report(predictions: DataFrame, least: float = 0.5) -> DataFrame:
    """Each track's share of slots with a label, and whether it needs review."""
    rows = predictions.groupBy("track_id").agg(F.count("*").alias("slots"), F.count("expected").alias("aligned"))
    return rows.withColumn("alignment_rate", rate("aligned", "slots")).withColumn("review", rate("aligned", "slots") < least)


def oracle_score(predictions: DataFrame) -> DataFrame:
    """As G1, correct if any candidate is right."""
    best = F.when(F.exists("candidates", lambda c: c == F.col("expected")), F.col("expected")).otherwise(F.get("candidates", F.lit(0)))
    return summarize(predictions.withColumn("word", best))


def replay_stats(predictions: DataFrame) -> DataFrame:
    """By class and creator the labelled and unlabelled slots, those predicted, and the tracks."""
    return predictions.groupBy("pair_class", "creator").agg(F.count_if(F.col("expected").isNotNull()).alias("labelled"), F.count_if(F.col("expected").isNull()).alias("unlabelled"), F.count_if(F.col("word").isNotNull()).alias("predicted"), F.count_distinct("track_id").alias("tracks"))


def vocabulary_audit(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Labels by class with counts, creators and whether the lexicon holds them; and words never seen."""
    seen = words.groupBy("pair_class", "expected").agg(F.count("*").alias("n"), F.count_distinct("creator").alias("creators"))
    known = lexicon.select(F.col("word").alias("expected"), F.lit(True).alias("known"))
    listed = seen.join(known, "expected", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    absent = known.join(seen.select("expected").distinct(), "expected", "left_anti").select(F.lit(None).cast("string").alias("pair_class"), "expected", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("creators"), "known")
    return listed.select("pair_class", "expected", "n", "creators", "known").unionByName(absent)


def vocabulary_candidates(hidden: DataFrame, visible: DataFrame, excluded: DataFrame, pair_class: str = "manual-auto") -> DataFrame:
    """Hidden words of the authoritative class that are never visible and not excluded."""
    words = hidden.where(F.col("pair_class") == pair_class).select(F.col("expected").alias("word")).distinct()
    return words.join(visible.select("word").distinct(), "word", "left_anti").join(excluded.select("word"), "word", "left_anti")


def wilson(rules: DataFrame) -> DataFrame:
    """The lower bound of each rule's precision."""
    return rules.withColumn("wilson", wilson_lower("correct", "attempted"))


def rule_audit(trace: DataFrame) -> DataFrame:
    """By rule all matches with their outcome and histograms of expected and predicted words.
    trace: rule_id, status, expected, word, creator."""
    rows = with_flags(trace.where("rule_id IS NOT NULL"))
    won = F.col("status") != "blocked"
    base = rows.groupBy("rule_id").agg(F.count("*").alias("matched"), F.count_if(won & F.col("is_scored")).alias("scored"), F.count_if(won & F.col("is_attempted")).alias("attempted"), F.count_if(won & F.col("is_correct")).alias("correct"), F.count_if(won & F.col("word").isNull()).alias("abstained"), F.count_distinct("creator").alias("creators"))
    # Both histograms in one pass: a won row counts once under its expected word and once under its predicted one.
    kinds = F.array(F.struct(F.lit("e").alias("kind"), F.col("expected").alias("w")), F.struct(F.lit("p").alias("kind"), F.col("word").alias("w")))
    counts = rows.where(won & F.col("is_scored")).select("rule_id", F.explode(kinds).alias("x")).where("x.w IS NOT NULL").groupBy("rule_id", "x.kind", "x.w").agg(F.count("*").alias("n"))
    entry = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.concat_ws("=", "w", F.col("n").cast("string")))))
    return base.join(counts.groupBy("rule_id").agg(entry("e").alias("expected_counts"), entry("p").alias("predicted_counts")), "rule_id", "left")


def leave_one_out(alternatives: DataFrame) -> DataFrame:
    """What each winning rule's removal does. alternatives: track_id, token_index, ord, rule_id, word, expected; the
    next alternative by ord takes the slot."""
    w = Window.partitionBy("track_id", "token_index").orderBy("ord", "rule_id")
    rows = alternatives.withColumn("rank", F.row_number().over(w)).withColumn("next_rule", F.lead("rule_id").over(w)).withColumn("next_word", F.lead("word").over(w)).where("rank = 1 AND expected IS NOT NULL")
    now, then = F.coalesce(F.col("word") == F.col("expected"), F.lit(False)), F.coalesce(F.col("next_word") == F.col("expected"), F.lit(False))
    wrong, then_wrong = F.col("word").isNotNull() & ~now, F.col("next_word").isNotNull() & ~then
    return rows.groupBy("rule_id").agg(F.count("*").alias("won"), F.count_if(now & ~then).alias("correct_lost"), F.count_if(~now & then).alias("correct_gained"), F.count_if(wrong & ~then_wrong).alias("wrong_avoided"), F.count_if(~wrong & then_wrong).alias("wrong_introduced"))


def audit_deltas(effects: DataFrame, baseline: DataFrame) -> DataFrame:
    """Precision and coverage of the whole if a rule were removed; baseline: one row of G1."""
    one = baseline.select(F.col("scored").alias("b_scored"), F.col("attempted").alias("b_attempted"), F.col("correct").alias("b_correct"))
    rows = effects.join(F.broadcast(one), F.lit(True))
    correct = F.col("b_correct") - F.col("correct_lost") + F.col("correct_gained")
    wrong = F.col("b_attempted") - F.col("b_correct") - F.col("wrong_avoided") + F.col("wrong_introduced")
    return rows.select("rule_id", F.when(correct + wrong > 0, correct / (correct + wrong)).alias("precision_without"), F.when(F.col("b_scored") > 0, correct / F.col("b_scored")).alias("coverage_without"))


def recommend(audit: DataFrame) -> DataFrame:
    """What to do with each rule; audit holds G14 and G15 columns."""
    precision = rate("correct", "attempted")
    advice = (
        F.when(F.col("won").isNull() | (F.col("won") == 0), "retire").when(F.col("attempted") == 0, "abstain").when((F.col("correct_lost") == 0) & (F.col("wrong_avoided") > 0), "remove")
        .when(F.col("wrong_avoided") > F.col("correct_lost"), "remove").when(precision < 0.7, "narrow").when(F.col("attempted") < 4, "candidate").otherwise("keep")
    )
    return audit.withColumn("advice", advice)


def rule_overlap_graph(alternatives: DataFrame) -> DataFrame:
    """Edges from winning rules to the rules that would take over, with counts and creators."""
    w = Window.partitionBy("track_id", "token_index").orderBy("ord", "rule_id")
    rows = alternatives.withColumn("rank", F.row_number().over(w)).withColumn("to_rule", F.lead("rule_id").over(w)).where("rank = 1 AND to_rule IS NOT NULL")
    return rows.groupBy(F.col("rule_id").alias("from_rule"), "to_rule").agg(F.count("*").alias("n"), F.count_distinct("creator").alias("creators"))


def paired_outcomes(a: DataFrame, b: DataFrame) -> DataFrame:
    """How often both, one or none of two predictions of the same scored slots is right."""
    one = lambda df, name: with_flags(df).where("is_scored").select("track_id", "token_index", F.col("is_correct").alias(name))
    return one(a, "a_ok").join(one(b, "b_ok"), ["track_id", "token_index"]).groupBy("a_ok", "b_ok").agg(F.count("*").alias("n"))


def validate_metrics(metrics: DataFrame) -> DataFrame:
    """(id, violation) of a metrics table: repeated ids, bad status, counts out of order, stored rates that differ,
    and, where the table has report, report_fingerprint and complete, rows without a whole report behind them."""
    close = lambda stored, k, n: F.abs(F.col(stored) - F.coalesce(rate(k, n), F.lit(0.0))) > 1e-9
    checks = {
        "status": ~F.coalesce(F.col("status").isin("current", "historical", "diagnostic"), F.lit(False)),
        "counts": ~((F.col("correct") <= F.col("attempted")) & (F.col("attempted") <= F.col("scored")) & (F.col("correct") >= 0)),
        "precision": F.coalesce(close("precision", "correct", "attempted"), F.lit(True)) | ~F.col("precision").between(0, 1),
        "coverage": F.coalesce(close("coverage", "correct", "scored"), F.lit(True)) | ~F.col("coverage").between(0, 1),
        "stale": F.col("fingerprint").isNull() & ~F.coalesce("stale", F.lit(False)),
    }
    if {"report", "report_fingerprint", "complete"} <= set(metrics.columns):
        backed = (F.trim("report") != "") & F.col("report_fingerprint").rlike("^sha256:[a-f0-9]{64}$") & F.col("complete")
        checks["provenance"] = ~F.coalesce(backed, F.lit(False))
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())
    rows = metrics.select("id", F.explode(found).alias("violation"))
    twice = metrics.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("violation"))
    return rows.unionByName(twice)


def upsert_metric(metrics: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same id."""
    return metrics.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def render_metrics(metrics: DataFrame) -> DataFrame:
    """One line of text a row, with percentages and a mark on stale ones."""
    pct = lambda c: F.when(F.col(c).isNull(), "–").otherwise(F.concat(F.format_number(F.col(c) * 100, 2), F.lit("%")))
    return metrics.select("id", F.concat_ws(" | ", F.col("id"), F.col("scored").cast("string"), pct("precision"), pct("coverage"), F.when(F.col("stale"), "stale").otherwise("current")).alias("line"))


def fill_rate(predictions: DataFrame, *by: str) -> DataFrame:
    """Share of slots with a fill; needs no labels."""
    return (predictions.groupBy(*by) if by else predictions).agg(F.count("*").alias("slots"), F.avg(F.col("word").isNotNull().cast("double")).alias("fill_rate"))


def creator_summary(predictions: DataFrame) -> DataFrame:
    """Each creator's slots, tracks, label histogram and baseline rates."""
    base = summarize(predictions, "creator").join(predictions.groupBy("creator").agg(F.count_distinct("track_id").alias("tracks")), "creator")
    hist = predictions.where("expected IS NOT NULL").groupBy("creator", "expected").agg(F.count("*").alias("n")).groupBy("creator").agg(F.sort_array(F.collect_list(F.concat_ws("=", "expected", F.col("n").cast("string")))).alias("labels"))
    return base.join(hist, "creator", "left")


def reuse_predictions(slots: DataFrame, previous: DataFrame, options: tuple[str, ...] = ()) -> DataFrame:
    """Results of tracks whose fingerprint is unchanged; ``reused`` false where a slot must be computed anew. options:
    columns of both tables (contexts, candidates, settings) that must be equal too, nulls to nulls."""
    held = ["track_id", "token_index", "fingerprint"]
    old = previous.select(*held, *[F.col(c).alias(f"old_{c}") for c in options], F.col("word").alias("old_word"), F.lit(True).alias("hit"))
    joined = slots.join(old, held, "left")
    same = F.coalesce("hit", F.lit(False))
    for c in options:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return joined.select("track_id", "token_index", F.when(same, F.col("old_word")).alias("word"), same.alias("reused"))


def reuse_counts(reused: DataFrame, *by: str) -> DataFrame:
    """How many slots were carried over and how many are to be computed."""
    return (reused.groupBy(*by) if by else reused).agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("computed"))


def rule_fingerprints(rules: DataFrame) -> DataFrame:
    """One fingerprint of each rule and, by tier, one of the ordered rules."""
    each = rules.select("tier", "ord", stable_id("rule", "rule_id", F.array_join("candidates", "|")).alias("fp"))
    return each.groupBy("tier").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "fp"))), lambda s: s["fp"]), "\n"), 256).alias("fingerprint"), F.count("*").alias("rules"))
