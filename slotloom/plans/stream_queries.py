"""Queries over sources (A) and the batch form of the streaming jobs (K). Payloads and reports are built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotloom.plans import base as B
from slotloom.plans.registry import Registry
from slotloom.sources import readers as A
from slotloom.sources.scratch import saved
from slotloom.streaming import jobs as K

R = Registry()


def _payloads(spark, d):
    """Conversations as caption payloads; every seventh one is broken."""
    turns = B.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("track_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    events = F.transform("ts", lambda t: F.struct((t["turn"] * 4000).alias("tStartMs"), F.lit(4000).alias("dDurationMs"), F.array(F.struct(t["text"].alias("utf8"))).alias("segs")))
    body = F.to_json(F.struct(F.lit("pb3").alias("wireMagic"), events.alias("events")))
    return turns.select("track_id", F.when(F.col("track_id") % 7 == 0, "{broken").otherwise(body).alias("payload"))


@R.add("SELECT conv_id AS track_id, true AS parsed, turn * 4000 AS start_ms, text FROM conversations WHERE conv_id % 7 > 0 UNION ALL SELECT DISTINCT conv_id, false, NULL, NULL FROM conversations WHERE conv_id % 7 = 0")
def a1_parse_payload(spark, d):
    return A.parse_payload(_payloads(spark, d)).select("track_id", "parsed", "start_ms", "text")


@R.add("SELECT lpad(c_custkey::VARCHAR, 11, 'x') AS id, true AS has_auto, c_custkey % 3 = 0 AS has_manual FROM customer")
def a2_pair_tracks(spark, d):
    k = F.lpad(F.col("c_custkey").cast("string"), 11, "x")
    c = B.table(spark, d, "customer")
    paths = c.select(F.concat(F.lit("/data/"), k, F.lit("_t_auto.en.json3")).alias("path")).union(c.where("c_custkey % 3 = 0").select(F.concat(F.lit("/data/"), k, F.lit("_t_manual.en.json3"))))
    return A.pair_tracks(paths)


@R.add("SELECT o_custkey AS report, o_orderkey::VARCHAR AS id, 'c' || o_custkey AS creator, CASE WHEN o_orderstatus = 'F' THEN 'manual-auto' ELSE 'kind' END AS pair_class, (o_orderkey % 9)::INT AS slots FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 9 > 0 UNION ALL SELECT o_custkey, 'extra' || max(o_orderkey), 'c' || o_custkey, 'synthetic', NULL FROM orders WHERE o_custkey % 9 > 0 GROUP BY o_custkey")
def a3_read_acquisition(spark, d):
    k = F.col("o_orderkey")
    item = F.struct(k.cast("string").alias("id"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("saved").alias("status"), F.lit("kind").alias("pairKind"), F.when(F.col("o_orderstatus") == "F", "manual-auto").alias("pairClass"), (k % 9).cast("int").alias("slots"))
    o = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("report")).agg(F.collect_list(item).alias("items"), F.max(k).alias("m"))
    name = F.concat(F.lit("c"), F.col("report").cast("string"))
    body = F.to_json(F.struct(F.array(F.struct(name.alias("name"), F.lit(True).alias("queueComplete"), F.col("items"))).alias("channels"), F.array(F.struct(F.lit("synthetic").alias("pairClass"), name.alias("creator"), F.array(F.concat(F.lit("extra"), F.col("m").cast("string"))).alias("ids"))).alias("provenance")))
    return A.parse_acquisition(o.select("report", F.when(F.col("report") % 9 > 0, body).otherwise("[broken").alias("body"))).select("report", "id", "creator", "pair_class", "slots")


@R.add("SELECT l_orderkey AS report, l_linenumber AS token_index, l_returnflag AS word, l_linestatus AS expected, l_partkey % 2 = 0 AS faithful FROM lineitem")
def a4_read_predictions(spark, d):
    x = F.struct(F.col("l_linenumber").alias("tokenIndex"), F.lit("ctx").alias("context"), F.when(F.col("l_partkey") % 2 == 0, "ctx").otherwise("other").alias("originalContext"), F.col("l_returnflag").alias("word"), F.array("l_linestatus").alias("expected"))
    r = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("report")).agg(F.collect_list(x).alias("results"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("f").alias("name"), F.col("results"))).alias("fixtures")))
    return A.parse_predictions(r.select("report", body.alias("body"))).select("report", "token_index", "word", "expected", "faithful")


@R.add("SELECT o_custkey || ':' || o_orderstatus AS key, 'repeated key' AS violation FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT o_custkey || ':' || o_orderstatus, 'label is null' FROM orders WHERE o_orderkey % 50 = 0")
def a5_read_labeled(spark, d):
    rows = B.table(spark, d, "orders").withColumn("label", F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderpriority")))
    return A.contract_violations(rows, ["label"], ["o_custkey", "o_orderstatus"])


@R.add("SELECT event_id AS seq, CASE WHEN event_id % 10 > 0 THEN event_type END AS type, CASE WHEN event_id % 10 > 0 THEN user_id::VARCHAR END AS id, event_id % 10 = 0 AS corrupt FROM events")
def a6_read_review_log(spark, d):
    e = B.table(spark, d, "events")
    line = F.to_json(F.struct(F.lit(1).alias("version"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("id")))
    return A.parse_review_log(e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 > 0, line).otherwise('{"type": ').alias("value"))).select("seq", "type", "id", "corrupt")


@R.add(r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 50 AND length(text) <= 3000")
def a7_read_text_corpus(spark, d):
    return A.filter_text_corpus(B.table(spark, d, "documents"), 50, 3000).select("doc_id")


@R.add("SELECT DISTINCT lower(trim(c_mktsegment)) AS word FROM customer")
def a8_read_lexicon(spark, d):
    """A vocabulary in upper and lower case, written and read."""
    words = B.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("word"))
    return A.read_lexicon(spark, saved(words, "lexicon"))


@R.add("SELECT rule_id, word, p FROM (SELECT p_brand AS rule_id, p_type AS word, (p_size % 7) / 5.0::DOUBLE AS p, (p_size % 5) / 5.0::DOUBLE AS margin, p_size AS support FROM part) WHERE p <= 1 AND margin <= p")
def a8_read_priors(spark, d):
    size = F.col("p_size")
    rows = B.table(spark, d, "part").select(F.col("p_brand").alias("rule_id"), F.col("p_type").alias("word"), (size % 7 / 5.0).alias("p"), (size % 5 / 5.0).alias("margin"), size.alias("support"))
    return A.read_priors(spark, saved(rows, "priors")).select("rule_id", "word", "p")


@R.add("SELECT l_suppkey AS source, count(*) AS before, count(*) FILTER (l_partkey % 50 > 0) AS after FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_partkey % 50 > 0) < count(*)")
def a9_publish_guard(spark, d):
    li = B.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "source")
    return A.lost_sources(li, li.where("l_partkey % 50 > 0"))


def _slot_events(spark, d):
    return B.table(spark, d, "conversations").select(F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("ts"), F.col("conv_id").alias("track_id"), F.col("turn").alias("event_index"), F.regexp_replace("text", r"(?i)\b(from|that|this|with)\b", "[__]").alias("text"))


_SLOT_SQL = r"SELECT conv_id AS track_id, turn AS event_index, unnest(range(0, len(p) - 1))::INT AS slot_in_event FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '(?i)\b(from|that|this|with)\b', '[__]', 'g'), '[__]') AS p FROM conversations)"


@R.add(_SLOT_SQL)
def k1_stream_slots(spark, d):
    return K.stream_slots(_slot_events(spark, d)).select("track_id", "event_index", "slot_in_event")


@R.add(_SLOT_SQL)
def k2_stream_dedup(spark, d):
    slots = K.stream_slots(_slot_events(spark, d))
    return K.stream_dedup(slots.union(slots)).select("track_id", "event_index", "slot_in_event")


@R.add("""SELECT a.event_id AS slot_id, b.event_id AS segment_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts - INTERVAL 3 SECOND AND b.ts + INTERVAL 30 MINUTE >= a.ts + INTERVAL 1.5 SECOND AND b.ts >= a.ts - INTERVAL 1 HOUR""".replace("INTERVAL 1.5 SECOND", "INTERVAL 1500 MILLISECOND"))
def k3_stream_join_segments(spark, d):
    e = B.table(spark, d, "events")
    slots = e.select("ts", F.col("user_id").alias("track_id"), F.col("event_id").alias("slot_id"))
    segments = e.select(F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL '30' MINUTE")).alias("end_ts"), F.col("user_id").alias("track_id"), F.col("event_id").alias("segment_id"))
    return K.stream_join_segments(slots, segments).select("slot_id", "segment_id")


def _resolutions(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "click", "rule").when(F.col("event_type") == "view", "context").otherwise("media")
    return B.table(spark, d, "events").select(F.col("user_id").alias("slot_id"), F.col("event_id").alias("seq"), F.concat(F.lit("w"), (F.col("event_id") % 5).cast("string")).alias("word"), kind.alias("source"))


_RES = "r AS (SELECT user_id AS slot_id, event_id AS seq, 'w' || event_id % 5 AS word, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'click' THEN 'rule' WHEN 'view' THEN 'context' ELSE 'media' END AS source FROM events)"


@R.add(f"WITH {_RES} SELECT slot_id, word, source FROM (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY CASE source WHEN 'confirmed' THEN 3 WHEN 'media' THEN 1 ELSE 2 END DESC, seq DESC) AS k FROM r) WHERE k = 1")
def k4_resolve_state(spark, d):
    return K.resolve_batch(_resolutions(spark, d))


@R.add(f"""WITH {_RES}, k AS (SELECT *, CASE WHEN word = 'w0' AND source = 'media' THEN 'clear' WHEN word IN ('w2', 'w3', 'w4') THEN 'set' WHEN source IN ('rule', 'context') THEN 'veto' END AS kind FROM r),
    l AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY seq DESC) AS n FROM k WHERE kind IN ('set', 'clear')), v AS (SELECT slot_id, max(seq) AS veto FROM k WHERE kind = 'veto' GROUP BY slot_id)
    SELECT slot_id, word, source FROM l LEFT JOIN v USING (slot_id) WHERE n = 1 AND kind = 'set' AND NOT (source = 'media' AND coalesce(veto > seq, false))""")
def k4b_fill_cache(spark, d):
    allowed = spark.range(1).select(F.explode(F.array(*map(F.lit, ["w2", "w3", "w4"]))).alias("word"))
    return K.fill_cache(_resolutions(spark, d).withColumn("word", F.when(F.col("word") != "w0", F.col("word"))), allowed)


@R.add("SELECT user_id % 10 AS session, user_id AS track_id, event_id % 4 AS slot_id, max(event_id) AS seq FROM events e WHERE event_id // 2000 = (SELECT max(event_id // 2000) FROM events f WHERE f.user_id = e.user_id) GROUP BY ALL")
def k5_invalidate_generation(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    rows = B.table(spark, d, "events").select((u % 10).alias("session"), u.alias("track_id"), F.floor(k / 2000).alias("generation"), (k % 4).alias("slot_id"), k.alias("seq"))
    return K.invalidate_generation(rows).select("session", "track_id", "slot_id", "seq")


@R.add("SELECT event_id, value - event_id % 20 > 1 AS late FROM events")
def k6_late_slots(spark, d):
    return K.late_slots(B.table(spark, d, "events").select("event_id", F.col("value").alias("playhead_s"), (F.col("event_id") % 20).alias("time_s"))).select("event_id", "late")


@R.add("""WITH g AS (SELECT user_id AS track_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(f) OVER (PARTITION BY track_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT track_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY track_id, s""")
def k7_window_groups(spark, d):
    rows = K.window_groups(B.table(spark, d, "events").select("ts", F.col("user_id").alias("track_id")), "1 hour")
    return rows.select("track_id", (F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "start") + 1704067200000000).alias("start_us"), "n")


_PACK = "t AS (SELECT user_id AS track_id, event_id AS token_index, epoch_us(ts) / 120000000 AS time_s FROM events)"


@R.add(f"""WITH RECURSIVE {_PACK}, w AS (SELECT track_id, min(time_s) AS f, 0 AS no FROM t GROUP BY track_id UNION ALL SELECT w.track_id, min(t.time_s), w.no + 1 FROM w JOIN t ON t.track_id = w.track_id AND t.time_s > w.f AND t.time_s + 1.5 > w.f - 3 + 30 GROUP BY w.track_id, w.no)
    SELECT track_id, token_index, no AS window_no, f - 3 AS opens FROM (SELECT t.track_id, token_index, no, f, row_number() OVER (PARTITION BY t.track_id, token_index ORDER BY no DESC) AS k FROM t JOIN w ON t.track_id = w.track_id AND w.f <= t.time_s) WHERE k = 1""")
def k7_pack_windows(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "ts") + 1704067200000000
    return K.pack_windows(B.table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("token_index"), (us / 120000000).alias("time_s")))


@R.add("""WITH r AS (SELECT user_id AS device, event_id AS seq, value / (0.74::DOUBLE + 0.64::DOUBLE * (event_id % 30)) AS ratio FROM events), h AS (SELECT device, seq, list_sort(list(ratio) OVER (PARTITION BY device ORDER BY seq ROWS 14 PRECEDING)) AS h FROM r)
    SELECT device, seq, h[len(h) // 2 + 1] AS median, len(h) >= 5 AND h[len(h) // 2 + 1] <= 1 AS fast FROM h""")
def k8_speed_monitor(spark, d):
    return K.speed_monitor(B.table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), F.col("value").alias("seconds"), (F.col("event_id") % 30).alias("slots")))


@R.add("SELECT l_suppkey AS source, l_orderkey AS row_id, CASE WHEN l_suppkey % 3 = 0 OR l_suppkey % 5 = 0 THEN 'reused' ELSE 'rebuilt' END AS origin FROM lineitem")
def k9_incremental_refresh(spark, d):
    li, s = B.table(spark, d, "lineitem"), F.col("l_suppkey")
    old = li.select(s.alias("source"), F.lit("h0").alias("source_hash"), F.col("l_orderkey").alias("row_id"))
    new = li.where("l_suppkey % 5 > 0 OR l_linenumber > 3").select(s.alias("source"), F.when(s % 3 == 0, "h0").otherwise("h1").alias("source_hash"), F.col("l_orderkey").alias("row_id"))
    return K.incremental_refresh(old, new).select("source", "row_id", "origin")


@R.add("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def k10_windowed_counts(spark, d):
    rows = K.windowed_counts(B.table(spark, d, "events").select("ts", F.col("event_type").alias("kind")))
    return rows.select((F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "start") + 1704067200000000).alias("start_us"), "kind", "n")
