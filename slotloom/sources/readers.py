"""Sources and sinks: caption payloads, track pairs, reports, datasets, logs, corpora, rules, and guarded publishing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.sources.versions import lost_sources, publish, published_version, read_published

__all__ = ["lost_sources", "publish", "published_version", "read_published"]

PAYLOAD = "struct<wireMagic:string,wpWinPositions:array<struct<rcRows:int>>,events:array<struct<tStartMs:bigint,dDurationMs:bigint,wWinId:int,segs:array<struct<utf8:string,tOffsetMs:bigint>>>>>"
NAME = r"([A-Za-z0-9_-]{11})[^/]*_(auto|manual)\.[^/]*$"
REPORT = "struct<channels:array<struct<name:string,channelId:string,queueComplete:boolean,items:array<struct<id:string,status:string,pairKind:string,pairClass:string,slots:int>>>>,provenance:array<struct<pairClass:string,creator:string,creatorId:string,ids:array<string>>>>"
RESULTS = "struct<complete:boolean,fixtures:array<struct<name:string,videoId:string,pairClass:string,creator:string,results:array<struct<tokenIndex:int,timeSeconds:double,context:string,originalContext:string,word:string,candidates:array<string>,expected:array<string>,ruleId:string>>>>>"
RULE_COLUMNS = ["rule_id", "tier", "ord", "candidates", "conditions"]


def parse_payload(tracks: DataFrame, payload: str = "payload") -> DataFrame:
    """A1: one row an event with its segments (segs) and fixed_page: whether it is an untimed event with a line break on a
    page of two rows (C2). A payload that does not parse gives one row with ``parsed`` false."""
    keep = [c for c in tracks.columns if c != payload]
    body = tracks.select(*keep, F.from_json(payload, PAYLOAD).alias("p"))
    rows = body.withColumn("parsed", F.col("p.events").isNotNull())
    two_rows = F.coalesce(F.exists("p.wpWinPositions", lambda w: F.coalesce(w["rcRows"] == 2, F.lit(False))), F.lit(False))
    rows = rows.select(*keep, "parsed", two_rows.alias("two_rows"), F.posexplode_outer("p.events").alias("event_index", "e"))
    rows = rows.where(~F.col("parsed") | F.col("e").isNotNull())
    segs = F.coalesce("e.segs", F.array().cast("array<struct<utf8:string,tOffsetMs:bigint>>"))
    text = F.array_join(F.transform(segs, lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    fixed = F.col("two_rows") & F.forall(segs, lambda s: s["tOffsetMs"].isNull()) & F.exists(segs, lambda s: F.coalesce(s["utf8"].contains("\n"), F.lit(False)))
    return rows.select(*keep, "parsed", "event_index", F.col("e.tStartMs").alias("start_ms"), F.coalesce("e.dDurationMs", F.lit(0)).alias("dur_ms"), F.when(F.col("parsed"), text).alias("text"), F.when(F.col("parsed"), segs).alias("segs"), (F.col("parsed") & fixed).alias("fixed_page"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A1, A2: payload files as (path, payload), whole file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def pair_tracks(tracks: DataFrame, path: str = "path") -> DataFrame:
    """A2: by id whether an auto and a manual side are there; ids and sides come from the names."""
    named = tracks.select(F.regexp_extract(path, NAME, 1).alias("id"), F.regexp_extract(path, NAME, 2).alias("side")).where("id <> ''")
    return named.groupBy("id").agg(F.bool_or(F.col("side") == "auto").alias("has_auto"), F.bool_or(F.col("side") == "manual").alias("has_manual"))


def parse_acquisition(reports: DataFrame, body: str = "body") -> DataFrame:
    """A3: one row a saved item and a back-filled id; an item's class falls back to the report's. Malformed ones give none."""
    parsed = reports.select("report", F.from_json(body, REPORT).alias("r"))
    items = parsed.select("report", F.explode("r.channels").alias("c")).select("report", "c.name", "c.channelId", "c.queueComplete", F.explode("c.items").alias("i")).where("i.status = 'saved'")
    items = items.select("report", F.col("i.id").alias("id"), F.col("name").alias("creator"), F.col("channelId").alias("creator_id"), F.coalesce("i.pairClass", "i.pairKind").alias("pair_class"), F.col("i.slots").alias("slots"), F.col("queueComplete").alias("complete"))
    filled = parsed.select("report", F.explode("r.provenance").alias("p")).select("report", F.explode("p.ids").alias("id"), F.col("p.creator").alias("creator"), F.col("p.creatorId").alias("creator_id"), F.col("p.pairClass").alias("pair_class"))
    return items.unionByName(filled, allowMissingColumns=True)


def parse_predictions(reports: DataFrame, body: str = "body") -> DataFrame:
    """A4: results of a report's fixtures with ``faithful``: the stored context is the original one."""
    parsed = reports.select("report", F.from_json(body, RESULTS).alias("r")).select("report", F.explode("r.fixtures").alias("f"))
    rows = parsed.select("report", F.col("f.name").alias("fixture"), F.col("f.creator").alias("creator"), F.explode("f.results").alias("x"))
    same = F.coalesce(F.col("x.originalContext") == F.col("x.context"), F.col("x.originalContext").isNotNull())
    return rows.select("report", "fixture", "creator", F.col("x.tokenIndex").alias("token_index"), F.col("x.context").alias("context"), F.col("x.word").alias("word"), F.get("x.expected", F.lit(0)).alias("expected"), same.alias("faithful"))


def contract_violations(rows: DataFrame, required: list[str], unique: list[str]) -> DataFrame:
    """A5: (key, violation) of a dataset: null in a required column, or a repeated key."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in unique])
    found = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required]), lambda v: v.isNotNull())
    missing = rows.select(key.alias("key"), F.explode(found).alias("violation"))
    twice = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated key").alias("violation"))
    return missing.unionByName(twice)


def read_labeled(spark: SparkSession, path: str, required: list[str], unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """A5: (rows, violations) of a Parquet dataset."""
    rows = spark.read.parquet(path)
    return rows, contract_violations(rows, required, unique)


def parse_review_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Events of a JSONL log; ``corrupt`` marks lines that do not parse or lack an id."""
    body = F.from_json(line, "struct<version:int,type:string,id:string,status:string,pattern:string,target:string,staleHash:string,timestamp:string>")
    rows = lines.select(*[c for c in lines.columns if c != line], body.alias("e"))
    return rows.select(*[c for c in lines.columns if c != line], "e.type", "e.id", "e.status", "e.pattern", "e.target", F.col("e.id").isNull().alias("corrupt"))


def filter_text_corpus(rows: DataFrame, min_words: int, max_chars: int, text: str = "text") -> DataFrame:
    """Texts of enough words and not too many characters."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    return rows.where((words >= min_words) & (F.length(text) <= max_chars))


def read_text_corpus(spark: SparkSession, path: str, kind: str, min_words: int, max_chars: int) -> DataFrame:
    """Auxiliary texts from JSONL ({original, censored}) or Parquet (text)."""
    rows = spark.read.json(path, schema="original string, censored string").withColumnRenamed("original", "text") if kind == "json" else spark.read.parquet(path)
    return filter_text_corpus(rows, min_words, max_chars)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table; it must have the rule columns."""
    rows = spark.read.parquet(path)
    lacking = [c for c in RULE_COLUMNS if c not in rows.columns]
    if lacking:
        raise ValueError(f"no rule table, lacks {lacking}")
    return rows


def _read_with(spark: SparkSession, path: str, columns: list[str], what: str) -> DataFrame:
    rows = spark.read.parquet(path)
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"no {what}, lacks {lacking}")
    return rows


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary (word, and what is known of it): lower-cased, trimmed, each word once, empty words left out."""
    rows = _read_with(spark, path, ["word"], "lexicon").withColumn("word", F.lower(F.trim("word"))).where("word <> ''")
    return rows.dropDuplicates(["word"])


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """Candidate priors (rule_id, word, p, margin, support), those within their bounds: 0 <= margin <= p <= 1."""
    rows = _read_with(spark, path, ["rule_id", "word", "p", "margin", "support"], "table of priors")
    return rows.where("p BETWEEN 0 AND 1 AND margin BETWEEN 0 AND p AND support >= 0")


DISCOVERY = {"contexts": ["context_id", "text"], "rows": ["row_id", "context_id", "slot_index", "label_status"], "sources": ["source", "source_hash"]}


def discovery_violations(contexts: DataFrame, rows: DataFrame) -> DataFrame:
    """A5: (key, violation) of a discovery dataset: a label that its status does not allow, or a context that is not there."""
    known, labels = F.col("label_status"), F.size(F.coalesce("expected_candidates", F.array().cast("array<string>")))
    wrong = F.when(~known.isin("known", "ambiguous", "unknown") | known.isNull(), "no such status").when((known == "known") & (F.col("expected").isNull() | (labels > 1)), "known without its one label")
    wrong = wrong.when((known == "ambiguous") & (labels < 2), "ambiguous with under two labels").when((known == "unknown") & (F.col("expected").isNotNull() | (labels > 0)), "unknown with a label")
    bad = rows.select(F.col("row_id").cast("string").alias("key"), wrong.alias("violation")).where("violation IS NOT NULL")
    lost = rows.join(contexts.select("context_id").distinct(), "context_id", "left_anti").select(F.col("row_id").cast("string").alias("key"), F.lit("no such context").alias("violation"))
    return bad.unionByName(lost)


def read_discovery(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """A5: ({contexts, rows, sources}, violations) of a discovery dataset: one Parquet folder each below ``path``."""
    tables = {k: _read_with(spark, f"{path}/{k}", columns, f"discovery table {k}") for k, columns in DISCOVERY.items()}
    return tables, discovery_violations(tables["contexts"], tables["rows"])
