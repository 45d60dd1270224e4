"""SimHash near-duplicates with pigeonhole blocks.

Words are runs of other characters than space and tab to carriage return, after A-Z are lower-cased; a shingle is
``width`` words joined by one space (all words, if fewer). Bit i of a fingerprint is 1 if it is set in over half of the
shingles' XXH64 hashes (repeats count). Null, empty and blank texts have no shingle: fingerprint zero, linked like any
other. Very long texts are hashed in steps. Repeated rows each get their row; an empty table gives no rows; extra
columns do not matter. Ids may be null: such rows are linked but never name a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.graph import components
from slotloom.llm.store import cut, join_unique

#: Blocks of more fingerprints than this are linked through shared one-bit neighbours instead of pairs.
PAIRED = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 15


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    total, hash_ = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for lo in range(0, len(first), _STEP):
        h = np.array([hash_(joined[a:b], seed) for a, b in zip(first[lo : lo + _STEP], last[lo : lo + _STEP])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = total * 2 > len(first)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` of the blocks: two fingerprints within the distance agree on
    all bits of one mask at least."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = [sum(x) for x in combinations(whole, blocks - distance)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def links(fps: DataFrame, distance: int = 2, blocks: int = 5, paired: int = PAIRED) -> DataFrame:
    """Edges a > b between distinct fingerprints (column fp) that join exactly those within ``distance`` bits: every
    such pair is linked, directly or through others within the distance of both ends of each edge.

    Small blocks are joined with themselves and verified. In a block of more than ``paired`` fingerprints pairs would
    grow with the square; there each fingerprint is linked to the least one sharing a neighbour within distance / 2
    bits, which holds just for those within the distance (distance must be 2 there).
    """
    choices = masks(distance, blocks)
    keyed = cut(fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in choices])).alias("block", "key")).withColumn("at", F.struct("block", "key")).select("fp", "block", "at"), "blocks")
    size = cut(keyed.groupBy("at").agg(F.count("*").alias("n")).where("n > 1"), "block-sizes")
    held = join_unique(keyed, size, "at", size, keyed.count())
    few, many = held.where(F.col("n") <= paired), held.where(F.col("n") > paired)
    other = few.select("at", F.col("fp").alias("b"))
    near = few.join(other, "at").where(F.col("fp") > F.col("b")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance).select(F.col("fp").alias("a"), "b")
    if distance != 2:
        raise ValueError("crowded blocks are linked for a distance of 2")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("bigint") for i in range(64)])
    mask = F.element_at(F.array(*[F.lit(m).cast("bigint") for m in choices]), F.col("block") + 1)
    # Only bits outside the block's mask can differ inside a block.
    neighbours = many.select("block", "fp", mask.alias("mask")).select("block", "fp", F.explode(F.filter(flips, lambda x: x.bitwiseAND(F.col("mask")) == 0)).alias("flip")).select("block", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("via"))
    neighbours = neighbours.select(F.struct("block", "via").alias("at"), "fp")
    # A neighbour that is shared is within a bit of both, so at most 65 fingerprints meet in one.
    least = neighbours.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
    star = neighbours.join(least, "at").where("fp > b").select(F.col("fp").alias("a"), "b")
    return near.union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id (smallest id reachable over links) of every row."""
    fps = cut(fingerprints(docs, id_col, text_col, width).withColumnRenamed(id_col, "id"), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    root = cut(components(links(classes.select("fp"), distance, blocks)), "roots")
    # The smallest fingerprint names a component first, its smallest id afterwards.
    owned = cut(classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "owned")
    named = owned.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_unique(owned.select("root", "fp"), named.select("root", "component_id"), "root", named.select("root", "n"), classes.count()).select("fp", "component_id")
    out = join_unique(fps, cut(named, "named"), "fp", classes.select("fp", "n"), fps.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
