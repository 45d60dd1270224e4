"""Sorts, top-k, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.sources.scratch import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Rows numbered from 0 in a total order without one task for all: ranks inside range partitions plus the counts
    of the partitions before (one row a partition). The dealt rows are written once: each shuffle by range draws a sample of
    its own for its bounds, so ranks and counts of two shuffles need not fit together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: partition ids stay the same
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = cut(ranged, "numbered")
    sizes = ranged.groupBy("__p").agg((F.max("__k") + 1).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return ranged.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__k")).drop("__p", "__k", "__base")


def distributed_sample(df: DataFrame, k: int, *order: str) -> DataFrame:
    """K evenly spaced rows of an order, the first and last among them; all, if there are no more."""
    n = df.count()
    if n <= k or k < 1:
        return df if k >= 1 else df.limit(0)
    # round(i (n - 1) / (k - 1)), halves up
    spots = df.sparkSession.range(k).select(F.floor(F.col("id") * (n - 1) / max(1, k - 1) + 0.5).alias("position"))
    return numbered(df, *order).join(F.broadcast(spots), "position", "left_semi").drop("position")


def round_robin_sample(df: DataFrame, stratum: str, fixture: str, key: str, k: int) -> DataFrame:
    """K rows in rounds over the strata; inside a stratum fixtures take turns. A fixed window definition stands for
    running counters: same cover, not the same list."""
    turn = df.withColumn("__turn", F.row_number().over(Window.partitionBy(stratum, fixture).orderBy(key)))
    ranked = turn.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy("__turn", fixture, key)))
    return ranked.orderBy("round", stratum).limit(k).drop("__turn")


def balanced_take(df: DataFrame, creator: str, key: str, k: int, taken: DataFrame) -> DataFrame:
    """K rows, one a creator a round, creators taken least so far first. taken: creator, n."""
    ranked = df.join(taken.select(creator, F.col("n").alias("__n")), creator, "left")
    ranked = ranked.withColumn("round", F.row_number().over(Window.partitionBy(creator).orderBy(key)) + F.coalesce("__n", F.lit(0)))
    return ranked.orderBy("round", creator, key).limit(k).drop("__n")


def sample_coverage(sample: DataFrame, candidates: DataFrame, *dimensions: str) -> DataFrame:
    """I4: by dimension how many of the candidates' values the sample covers."""
    counts = lambda df, name: df.agg(*[F.count_distinct(d).alias(d) for d in dimensions]).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias(name)) for d in dimensions])).alias("s")).select("s.*")
    return counts(sample, "covered").join(counts(candidates, "candidates"), "dimension")


def triage_queue(df: DataFrame, category: str, key: str, most: int, reserve: int) -> DataFrame:
    """All disagreements; ``reserve`` rows of both-empty; the rest is split evenly, unused shares handed over."""
    counts = {r[0]: r[1] for r in df.groupBy(category).count().collect()}
    whole = min(counts.get("disagreement", 0), most)
    held = min(counts.get("both-empty", 0), reserve, most - whole)
    quota, left = {"disagreement": whole, "both-empty": held}, most - whole - held
    others = sorted((c for c in counts if c not in quota), key=lambda c: (counts[c], str(c)))
    for i, c in enumerate(others):
        quota[c] = min(counts[c], left // (len(others) - i))
        left -= quota[c]
    share = F.coalesce(*[F.when(F.col(category).eqNullSafe(F.lit(c)), n) for c, n in quota.items()], F.lit(0))
    return df.withColumn("k", F.row_number().over(Window.partitionBy(category).orderBy(key))).where(F.col("k") <= share).drop("k")


def failure_triage(df: DataFrame, kind: str, creator: str, key: str, most: int) -> DataFrame:
    """Errors first, a tenth of controls and a twentieth of reviews, creators in turn."""
    quota = F.when(F.col(kind) == "control", most // 10).when(F.col(kind) == "review", most // 20).otherwise(most - most // 10 - most // 20)
    turn = df.withColumn("__turn", F.row_number().over(Window.partitionBy(kind, creator).orderBy(key)))
    ranked = turn.withColumn("k", F.row_number().over(Window.partitionBy(kind).orderBy("__turn", creator, key)))
    return ranked.where(F.col("k") <= quota).drop("__turn", "k")


def hash_shuffle(df: DataFrame, key: str) -> DataFrame:
    """Rows in an order that depends on the key's hash alone."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key)


def top_examples(df: DataFrame, lead: str, counter: str, key: str, k: int = 8) -> DataFrame:
    """I8: up to k distinct keys a lead, counterexamples first."""
    one = df.dropDuplicates([lead, key])
    w = Window.partitionBy(lead).orderBy(F.desc(F.col(counter).cast("int")), key)
    return one.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def intersect_counts(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """How many distinct keys both tables hold."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("shared"))


def except_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of a whose keys b lacks."""
    return a.join(b.select(*keys), list(keys), "left_anti")


def distinct_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
