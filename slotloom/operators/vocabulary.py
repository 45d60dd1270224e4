"""Vocabulary: lexicon words in texts, compounds, families, and which rows count as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.functions import text as T

# The classes of track pairs that are tiers of evidence.
TIERS = {"manual-auto": "manual-auto", "manual": "manual-auto", "real": "manual-auto", "synthetic": "synthetic"}


def extract_lexicon(rows: DataFrame, lexicon: DataFrame, key: str = "track_id", text: str = "text", longest: int | None = None) -> DataFrame:
    """``key``, pos (word number) and label of every entry of the lexicon (word; of up to ``longest`` words, by default
    as many as its longest has) in the texts: whole words, at each place the longest entry. ``word's`` has the label of ``word`` unless it is an entry itself. Entries
    inside a longer one that begins before them are left out."""
    if longest is None:
        longest = lexicon.agg(F.max(F.size(F.split(F.trim("word"), r"\s+")))).first()[0] or 1
    words = rows.select(F.col(key).alias("key"), F.explode(F.array(T.lexical_words(text))).alias("w"))

    def of(n: int) -> Column:
        """All runs of n words, each with its place."""
        places = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("gram")))

    grams = words.select("key", F.explode(F.concat(*[of(n) for n in range(1, longest + 1)])).alias("g")).select("key", "g.pos", "g.n", "g.gram")
    root = F.regexp_replace("gram", "'s$", "")
    tried = grams.select("key", "pos", "n", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("cut"), F.col("gram").alias("word")), F.struct(F.when(root != F.col("gram"), 1).otherwise(0).alias("cut"), root.alias("word"))))).alias("t")).select("key", "pos", "n", "t.cut", "t.word")
    hits = tried.join(lexicon.select(F.lower("word").alias("word")).distinct(), "word")
    best = hits.groupBy("key", "pos").agg(F.max(F.struct("n", (-F.col("cut")).alias("whole"), "word")).alias("b")).select("key", "pos", "b.n", "b.word")
    # An entry of n words covers the n - 1 places after its first.
    covered = best.where("n > 1").select("key", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
    return best.join(covered, ["key", "pos"], "left_anti").select(F.col("key").alias(key), "pos", F.col("word").alias("label"))


def normalize_compound(labels: DataFrame, compounds: DataFrame) -> DataFrame:
    """Labels (label, left, right: the words beside the slot) with ``label`` replaced by ``out`` where the compound's
    other half is visible on its side. compounds: label, side (left or right), visible, out."""
    table = compounds.select("label", "side", F.col("visible").alias("__seen"), F.col("out").alias("__out"))
    for side in ("left", "right"):
        own = table.where(F.col("side") == side).drop("side").dropDuplicates(["label", "__seen"]).withColumnRenamed("__seen", side)
        labels = labels.join(own, ["label", side], "left").withColumn("label", F.coalesce("__out", "label")).drop("__out")
    return labels


def same_family(pairs: DataFrame, families: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with ``same_family``: different words of one inflection family. families: word, family."""
    of = lambda c: families.select(F.col("word").alias(c), F.col("family").alias(f"__{c}")).dropDuplicates([c])
    joined = pairs.join(of(a), a, "left").join(of(b), b, "left")
    same = (F.col(a) != F.col(b)) & (F.col(f"__{a}") == F.col(f"__{b}"))
    return joined.withColumn("same_family", F.coalesce(same, F.lit(False))).drop(f"__{a}", f"__{b}")


def tier(pair_class: Column | str) -> Column:
    """The tier of a pair class; null for classes that are no evidence."""
    value = F.lower(F.trim(F.col(pair_class) if isinstance(pair_class, str) else pair_class))
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in TIERS.items()])


def known_creator(creator_id: Column | str, name: Column | str) -> Column:
    """Whether a row's creator can be told."""
    return T.creator_key(creator_id, name).isNotNull()


def single_label(expected: Column | str) -> Column:
    """Whether a row has just one expected word."""
    return F.coalesce(F.size(F.array_distinct(F.col(expected) if isinstance(expected, str) else expected)) == 1, F.lit(False))


def eligible(evidence: Column | str) -> Column:
    """Rows count unless they are marked as no evidence."""
    return F.coalesce(F.col(evidence) if isinstance(evidence, str) else evidence, F.lit(True))
