"""Connected components of a large edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.store import cut, join_unique


def _stars(now: DataFrame) -> bool:
    """Whether every child has one root and no root is a child."""
    children = now.groupBy("u").agg(F.count("*").alias("n"))
    return children.where("n > 1").isEmpty() and now.select(F.col("v").alias("u")).distinct().join(children, "u", "left_semi").isEmpty()


def _to_least(rows: DataFrame, total: int, least: DataFrame) -> DataFrame:
    """rows (u, v) with the least m of each u. least: u, m and n, the rows of u."""
    return join_unique(rows, least.select("u", "m"), "u", least.select("u", "n"), total)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node reachable, for every node of an edge (null ends are left out).

    Each round links every node's larger neighbours to its least one (large star), then its smaller neighbours and
    itself to the least (small star). Rounds go on until the edges are stars, however many that takes; for a chain of n
    nodes that is about log n. Least neighbours are minima made before the shuffle, and nodes of very many neighbours
    meet them by broadcast (``join_unique``), so none of their neighbourhoods meets in one task.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = _to_least(both.where("v > u"), now.count(), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u > v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _to_least(large, large.count(), least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u > v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
