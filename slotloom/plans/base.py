"""How the driver's tables are read as tracks, events, slots and labels, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.operators import slots as S
from slotloom.sources.scratch import cut

LEXICON = ["with", "this", "from", "that"]
_WRITTEN: ContextVar[dict | None] = ContextVar("written", default=None)


@contextmanager
def shared_slots() -> Iterator[None]:
    """Inside, the labelled slots of a folder are made and written once, and read again by each use."""
    token = _WRITTEN.set({})
    try:
        yield
    finally:
        _WRITTEN.reset(token)


def once(name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Inside ``shared_slots`` the table of that name, written at its first use; else made anew."""
    held, key = _WRITTEN.get(), (name, sf_dir)
    if held is None:
        return make()
    if key not in held:
        held[key] = cut(make(), name)
    return held[key]


def kept(name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``once`` has written, or else made anew: queries that use it only once need not write it."""
    held = _WRITTEN.get() or {}
    return held[name, sf_dir] if (name, sf_dir) in held else make()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, LEXICON))).alias("word"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tracks: track_id, text, creator, pair_class."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("track_id"), "text", F.col("source").alias("creator"))
    docs = docs.repartition("track_id")  # windows by track find their partitioning here
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id"), "quality")
    kind = F.when(F.col("quality") == 1, "manual-auto").when(F.col("quality") == 0, "synthetic").otherwise("unknown")
    return docs.join(labels, "track_id", "left").select("track_id", "text", "creator", kind.alias("pair_class"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mask_lexicon(tracks(spark, sf_dir), lexicon(spark))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.line_events(masked(spark, sf_dir))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extract_slots(events(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str, before: int = 2, after: int = 2) -> DataFrame:
    """Slots with features around them and the hidden word: track_id, creator, pair_class, token_index, at, features,
    breaks, expected."""
    words = F.regexp_extract_all(F.lower("original"), F.lit(r"\b(" + "|".join(sorted(LEXICON)) + r")\b"), 1)
    texts = masked(spark, sf_dir).select("track_id", "creator", "pair_class", "text", words.alias("hidden"))
    held, key = _WRITTEN.get(), (sf_dir, before, after)
    if held is not None and key in held:
        return held[key]
    rows = S.slot_features(texts, before, after, hidden="hidden").select("track_id", "creator", "pair_class", "token_index", "at", "features", "breaks", "expected")
    if held is not None:
        rows = held[key] = cut(rows, "labelled-slots")
    return rows


_PAT = r"\b(from|that|this|with)\b"
_WORD = r"(\*|\[__\]|[\p{L}\p{N}_'']+)"
#: CTEs, each using those before it. Their patterns of markers, words and sentence ends are the fixed values of functions.text.
CTES = {
    "tracks": "SELECT doc_id AS track_id, text, source AS creator, CASE quality WHEN 1 THEN 'manual-auto' WHEN 0 THEN 'synthetic' ELSE 'unknown' END AS pair_class FROM documents LEFT JOIN labels USING (doc_id)",
    "masked": rf"SELECT * FROM (SELECT track_id, regexp_replace(text, '(?i){_PAT}', '[__]', 'g') AS text, text AS original, creator, pair_class FROM tracks) WHERE contains(text, '[__]')",
    "lines": "SELECT track_id, creator, pair_class, unnest(range(0, len(l)))::INT AS event_index, unnest(l) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM masked)",
    "units": r"SELECT *, len(regexp_extract_all(text, '(\[__\]|[\p{L}\p{N}'']+)'))::BIGINT AS n_units, len(regexp_extract_all(text, '\[__\]')) AS n FROM lines",
    "events": "SELECT track_id, creator, pair_class, event_index, 300 * coalesce(sum(n_units) OVER w, 0)::BIGINT AS start_ms, 300 * n_units AS dur_ms, text, n, coalesce(sum(n) OVER w, 0)::BIGINT AS base FROM units WINDOW w AS (PARTITION BY track_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "slots": "SELECT track_id, (base + k)::INT AS token_index, event_index, k::INT AS slot_in_event, (length(array_to_string(p[1:k + 1], '[__]')))::INT AS char_off, start_ms, dur_ms, text FROM (SELECT *, unnest(range(0, n)) AS k, string_split(text, '[__]') AS p FROM events)",
    "timed": r"SELECT *, (start_ms + dur_ms::DOUBLE * len(regexp_extract_all(substr(text, 1, char_off), '(\[__\]|[\p{L}\p{N}'']+)')) / greatest(len(regexp_extract_all(text, '(\[__\]|[\p{L}\p{N}'']+)')), 1)) / 1000.0 AS time_s FROM slots",
    "words": rf"""SELECT track_id, creator, pair_class, ow, list_transform(ow, lambda x: lower(x)) AS w, g, hidden FROM (SELECT track_id, creator, pair_class, regexp_extract_all(folded, '{_WORD}', 1) AS ow, string_split_regex(folded, '{_WORD}') AS g,
        regexp_extract_all(lower(original), '{_PAT}', 1) AS hidden FROM (SELECT *, replace(replace(replace(text, chr(160), ' '), '’', ''''), '‘', '''') AS folded FROM masked))""",
    # Words around a slot (l2, l1, r1, r2), whether a rule may reach them (jl2 ...), and the text near it, from the gaps.
    "labelled": r"""SELECT track_id, creator, pair_class, (row_number() OVER w - 1)::INT AS token_index, spot, hidden[(row_number() OVER w)] AS expected, l2, l1, r1, r2, jl1, jl1 AND jl0 AS jl2, jr1, jr1 AND jr0 AS jr2,
        (regexp_matches(tail, '^\s*>>') OR regexp_matches(tail, '^\s*["''(\[]*(I\b|[A-Z][a-z]|[A-Z]{2,}\s+[a-z])')) AND NOT regexp_matches(tail, '^\s*[.!?]') AND NOT regexp_matches(head, '(?i)\b(go|going|went|gone)\s+to\s*$')
          AND NOT (regexp_matches(head, '(?i)(whatever|what|how|why|where|who|when)\s+the\s*$') AND regexp_matches(tail, '^\s*(I|you|he|she|they|we|it)\b')) AS breaks
      FROM (SELECT track_id, creator, pair_class, hidden, spot, CASE WHEN spot > 1 THEN w[spot - 1] ELSE '<BOS>' END AS l2, CASE WHEN spot > 0 THEN w[spot] ELSE '<BOS>' END AS l1, CASE WHEN spot + 1 < len(w) THEN w[spot + 2] ELSE '<EOS>' END AS r1, CASE WHEN spot + 2 < len(w) THEN w[spot + 3] ELSE '<EOS>' END AS r2,
        CASE WHEN spot > 0 THEN regexp_full_match(g[spot + 1], '[\s,"“”]+') ELSE g[1] = '' END AS jl1, CASE WHEN spot > 1 THEN regexp_full_match(g[spot], '[\s,"“”]+') WHEN spot = 1 THEN g[1] = '' ELSE true END AS jl0,
        spot + 1 >= len(w) OR regexp_full_match(g[spot + 2], '\s+') AS jr1, spot + 2 >= len(w) OR regexp_full_match(g[spot + 3], '\s+') AS jr0,
        CASE WHEN spot > 1 THEN ow[spot - 1] ELSE '' END || CASE WHEN spot > 0 THEN g[spot] || ow[spot] ELSE '' END || g[spot + 1] AS head, coalesce(g[spot + 2], '') || coalesce(ow[spot + 2], '') || coalesce(g[spot + 3], '') || coalesce(ow[spot + 3], '') AS tail
        FROM (SELECT *, unnest(range(0, len(w)))::INT AS spot FROM words) WHERE w[spot + 1] = '[__]') WINDOW w AS (PARTITION BY track_id ORDER BY spot)""",
    "features": """SELECT track_id, creator, pair_class, token_index, expected, breaks, off, CASE off WHEN -2 THEN l2 WHEN -1 THEN l1 WHEN 1 THEN r1 ELSE r2 END AS tok, CASE off WHEN -2 THEN jl2 WHEN -1 THEN jl1 WHEN 1 THEN jr1 ELSE jr2 END AS joined
        FROM labelled, (VALUES (-2), (-1), (1), (2)) o(off)""",
}
NEEDS = {"tracks": [], "masked": ["tracks"], "lines": ["masked"], "units": ["lines"], "events": ["units"], "slots": ["events"], "timed": ["slots"], "words": ["masked"], "labelled": ["words"], "features": ["labelled"]}


def sql(*needed: str, more: str = "", body: str) -> str:
    """A query with the CTEs it needs (and theirs) before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS[name]:
            add(x)
        if name not in order:
            order.append(name)

    for x in needed:
        add(x)
    parts = [f"{x} AS MATERIALIZED ({CTES[x]})" for x in order] + ([more] if more else [])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
