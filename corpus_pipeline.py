"""Training-corpus pipeline over ``documents``: five stages, each one of the library's pipeline operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of their input, whatever these are called. Where SQL cannot express a stage (learned models, SimHash, BPE),
tests hold the stage against a brute-force version.

In all stages null texts count as empty and null ids are rows like others, very long texts are read whole, and an empty
table gives an empty table. Quality: an empty text has the score of empty features; equal texts fare alike. Language: texts
without a letter are rejected. Near-duplicates: rows without a word are one group; of rows that repeat id and text one
stays, and of a group the row of the least id (rows without id last; ties by a hash of the text). Decontamination: texts
without a word stay. Tokens: one row each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotloom.llm import bpe, decontam, langid, nearcopies, quality
from slotloom.llm.store import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the operator's threshold."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return quality.keep_good(docs, quality.learn(docs, _table(spark, sf_dir, "labels"), length_col=length), length_col=length)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is not rejected."""
    return langid.keep_accepted(docs, langid.learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints within 2 bits or by a Jaccard of 0.8 or more over five-word
    shingles: the one whose id names the group."""
    return nearcopies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level bpe", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
