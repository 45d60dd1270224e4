"""Decisions over scored candidates: slot_id, word, list_order, logp. Producing the scores is not part of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def combine_variants(scores: DataFrame) -> DataFrame:
    """L1: log-sum-exp of a word's variants."""
    top = scores.groupBy("slot_id", "word").agg(F.max("logp").alias("m"), F.min("list_order").alias("list_order"), F.collect_list("logp").alias("xs"))
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))
    return top.select("slot_id", "word", "list_order", (F.col("m") + F.log(total)).alias("logp"))


def _ranked(scores: DataFrame, least: float) -> DataFrame:
    w = Window.partitionBy("slot_id").orderBy(F.desc("logp"), "list_order")
    return scores.where(F.col("logp") >= least).withColumn("k", F.row_number().over(w)).where("k <= 2")


def choose_scored(scores: DataFrame, least: float = -4.0) -> DataFrame:
    """L2: the best word at or over the gate; ties by list order."""
    return _ranked(scores, least).where("k = 1").drop("k")


def uncertain(scores: DataFrame, least: float = -4.0, margin: float = 1.0) -> DataFrame:
    """L3: slots without a word over the gate, or whose best two are within the margin."""
    best = _ranked(scores, least).groupBy("slot_id").agg(F.max(F.when(F.col("k") == 1, F.col("logp"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("logp"))).alias("b"))
    flag = F.col("a").isNull() | F.coalesce(F.col("a") - F.col("b") <= margin, F.lit(False))
    return scores.select("slot_id").distinct().join(best, "slot_id", "left").select("slot_id", flag.alias("uncertain"))


def fuse_scores(own: DataFrame, other: DataFrame, weights: tuple[float, float], fill: float, threshold: float, chosen: DataFrame | None = None, families: DataFrame | None = None) -> DataFrame:
    """L4: softmax of two models' weighted log scores; words the other model lacks get ``fill``; below the threshold no word.
    chosen: slot_id, word, uncertain: the other model's choice (L2, L3). It stands below the threshold, where the scored
    words lack it, and, unless uncertain, where the best word is another form of its family (families: word, family)."""
    joined = own.join(other.select("slot_id", "word", F.col("logp").alias("other_logp")), ["slot_id", "word"], "left")
    z = joined.withColumn("z", weights[0] * F.col("logp") + weights[1] * F.coalesce("other_logp", F.lit(fill)))
    everyone = Window.partitionBy("slot_id")
    ranked = z.withColumn("p", F.exp("z") / F.sum(F.exp("z")).over(everyone)).withColumn("k", F.row_number().over(everyone.orderBy(F.desc("z"), "list_order")))
    if chosen is None:
        return ranked.where("k = 1").select("slot_id", F.when(F.col("p") >= threshold, F.col("word")).alias("word"), "p")
    held = ranked.join(chosen.select("slot_id", F.col("word").alias("choice"), "uncertain"), "slot_id", "left")
    held = held.withColumn("scored", F.max((F.col("word") == F.col("choice")).cast("int")).over(everyone)).where("k = 1")
    of = lambda c: (families if families is not None else own.sparkSession.createDataFrame([], "word string, family string")).select(F.col("word").alias(c), F.col("family").alias(f"{c}_family")).dropDuplicates([c])
    held = held.join(of("word"), "word", "left").join(of("choice"), "choice", "left")
    form = ~F.coalesce("uncertain", F.lit(True)) & F.coalesce(F.col("word_family") == F.col("choice_family"), F.lit(False))
    stands = F.col("choice").isNotNull() & ((F.coalesce("scored", F.lit(0)) == 0) | form)
    return held.select("slot_id", F.when(stands | (F.col("p") < threshold), F.col("choice")).otherwise(F.col("word")).alias("word"), "p")


def arbitrate(by_rules: DataFrame, by_scores: DataFrame, mode: str = "rules-first") -> DataFrame:
    """Word and source of every slot; mode: rules, rules-first, scores-first or scores-only."""
    order = {"rules": ["rule"], "rules-first": ["rule", "score"], "scores-first": ["score", "rule"], "scores-only": ["score"]}[mode]
    joined = by_rules.join(by_scores, ["track_id", "token_index"], "full_outer")
    words = [F.col(f"{x}_word") for x in order]
    source = F.coalesce(*[F.when(F.col(f"{x}_word").isNotNull(), f"{x}s") for x in order])
    return joined.select("track_id", "token_index", F.coalesce(*words).alias("word"), source.alias("source"))
