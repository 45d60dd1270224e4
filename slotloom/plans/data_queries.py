"""Queries over provenance (F), sampling and sets (I, J), review (M) and acquisition (N), on the star schema and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotloom.operators import acquisition as N
from slotloom.operators import provenance as P
from slotloom.operators import review as V
from slotloom.operators import sampling as I
from slotloom.plans import base as B
from slotloom.plans.registry import Registry

R = Registry()
# Items: a part is an id, its lines are reports.
_ITEMS = """items AS (SELECT l_partkey AS id, CASE WHEN l_partkey % 3 = 0 OR l_returnflag = 'N' THEN 'synthetic' WHEN l_partkey % 3 = 1 THEN 'manual-auto' END AS pair_class, CASE WHEN l_partkey % 4 = 0 THEN 'N/A' ELSE 'sup' || l_suppkey % 2 END AS creator,
  CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 7 END AS creator_id, l_orderkey || ':' || l_linenumber AS report, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_linestatus = 'F' OR l_partkey % 2 = 0 END AS complete, CASE WHEN l_partkey % 11 = 0 THEN 'm' || l_suppkey % 2 ELSE 'm' END AS manual_path FROM lineitem)"""


def _items(spark, d):
    li = B.table(spark, d, "lineitem")
    k = F.col("l_partkey")
    return li.select(
        k.alias("id"), F.when((k % 3 == 0) | (F.col("l_returnflag") == "N"), "synthetic").when(k % 3 == 1, "manual-auto").alias("pair_class"), F.when(k % 4 == 0, "N/A").otherwise(F.concat(F.lit("sup"), (F.col("l_suppkey") % 2).cast("string"))).alias("creator"),
        F.when(k % 5 > 0, k % 7).alias("creator_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("report"), F.when(k % 6 != 0, (F.col("l_linestatus") == "F") | (k % 2 == 0)).alias("complete"),
        F.when(k % 11 == 0, F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string"))).otherwise("m").alias("manual_path"),
    )


# Rows: an order is a fixture, the supplier's parity its version, the line its slot.
_ROWS = """rws AS (SELECT l_orderkey AS fixture, 'v' || l_suppkey % 2 AS version, l_linenumber % 4 AS slot, l_partkey % 5 AS observation, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS expected, l_linestatus = 'F' AS faithful, 's' || l_suppkey % 3 AS source FROM lineitem)"""


def _rows(spark, d):
    li = B.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("fixture"), F.concat(F.lit("v"), (F.col("l_suppkey") % 2).cast("string")).alias("version"), (F.col("l_linenumber") % 4).alias("slot"), (F.col("l_partkey") % 5).alias("observation"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("expected"), (F.col("l_linestatus") == "F").alias("faithful"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"))


@R.add("SELECT o_orderkey AS id, o_orderstatus AS pair_kind, CASE o_orderstatus WHEN 'F' THEN 'manual-auto' WHEN 'O' THEN 'synthetic' END AS pair_class FROM orders")
def f1_classify_pair_kind(spark, d):
    kinds = spark.range(1).select(F.explode(F.array(F.struct(F.lit("F").alias("pair_kind"), F.lit("manual-auto").alias("pair_class")), F.struct(F.lit("O").alias("pair_kind"), F.lit("synthetic").alias("pair_class")))).alias("k")).select("k.*")
    return P.classify_pair_kind(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("pair_kind")), F.broadcast(kinds)).select("id", "pair_kind", "pair_class")


@R.add(f"WITH {_ITEMS} SELECT id, CASE WHEN bool_or(NOT complete) THEN 'incomplete' WHEN bool_and(coalesce(complete, false)) THEN 'complete' ELSE 'legacy' END AS evidence FROM items GROUP BY id")
def f2_evidence_status(spark, d):
    return P.evidence_status(_items(spark, d))


@R.add(f"""WITH {_ITEMS} SELECT id, CASE WHEN count(DISTINCT pair_class) > 1 THEN 'conflict' WHEN count(pair_class) = 0 THEN 'unknown' ELSE min(pair_class) END AS pair_class, CASE WHEN count(DISTINCT CASE WHEN creator <> 'N/A' THEN creator END) = 1 THEN min(CASE WHEN creator <> 'N/A' THEN creator END) END AS creator,
    count(DISTINCT report) AS reports, count(DISTINCT pair_class) = 1 AND bool_or(coalesce(complete, true) AND pair_class IS NOT NULL) AS eligible FROM items GROUP BY id""")
def f3_provenance_index(spark, d):
    return P.provenance_index(_items(spark, d))


@R.add(f"""WITH {_ITEMS} SELECT id, CASE WHEN q THEN 'conflict' WHEN o THEN 'incomplete' WHEN a THEN 'complete' ELSE 'legacy' END AS status, q AS quarantined FROM
    (SELECT id, count(DISTINCT pair_class) > 1 OR count(DISTINCT creator_id) > 1 OR count(creator_id) = 0 AND count(DISTINCT lower(creator)) > 1 OR count(DISTINCT manual_path) > 1 AS q, coalesce(bool_or(NOT complete), false) AS o, bool_and(coalesce(complete, false)) AS a FROM items GROUP BY id)""")
def f4_source_groups(spark, d):
    return P.source_groups(_items(spark, d))


@R.add(f"""WITH {_ROWS}, v AS (SELECT fixture, version, row_number() OVER (PARTITION BY fixture ORDER BY count(*) FILTER (faithful) DESC, count(expected) DESC, count(*) DESC, version) AS k FROM rws GROUP BY fixture, version)
    SELECT fixture, version, slot, observation FROM rws JOIN v USING (fixture, version) WHERE k = 1""")
def f5_select_version(spark, d):
    return P.select_version(_rows(spark, d)).select("fixture", "version", "slot", "observation")


@R.add(f"WITH {_ROWS} SELECT fixture, slot, count(DISTINCT observation) AS observations, count(*) - count(DISTINCT observation) AS repeats, count(DISTINCT observation) > 1 AS conflict FROM rws GROUP BY fixture, slot")
def f6_slot_conflicts(spark, d):
    return P.slot_conflicts(_rows(spark, d))


@R.add(f"""WITH {_ROWS} SELECT fixture, slot, bool_or(faithful) AS faithful, list_sort(list(DISTINCT source)) AS sources, coalesce(min(expected) <> max(expected), false) AS label_conflict FROM rws GROUP BY fixture, slot""")
def f7_merge_rows(spark, d):
    rows = _rows(spark, d)
    return P.merge_rows(rows.where("version = 'v0'"), rows.where("version = 'v1'")).select("fixture", "slot", "faithful", "sources", "label_conflict")


@R.add(f"""WITH {_ROWS}, a AS (SELECT DISTINCT fixture, slot, observation FROM rws WHERE version = 'v0'), b AS (SELECT DISTINCT fixture, slot, observation FROM rws WHERE version = 'v1'), x AS (SELECT DISTINCT fixture, slot FROM a), y AS (SELECT DISTINCT fixture, slot FROM b)
    SELECT (SELECT count(*) FROM x JOIN y USING (fixture, slot)) AS same_slot, (SELECT count(*) FROM x ANTI JOIN y USING (fixture, slot)) AS only_archive, (SELECT count(*) FROM y ANTI JOIN x USING (fixture, slot)) AS only_local, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS same_observation""")
def f7_merge_overlap(spark, d):
    rows = _rows(spark, d)
    return P.merge_overlap(rows.where("version = 'v0'"), rows.where("version = 'v1'"))


_CUST = "cu AS (SELECT c_custkey, lower(c_mktsegment) || c_nationkey % 9 AS creator, CASE WHEN c_custkey % 3 > 0 THEN 'id' || c_nationkey % 2 || c_mktsegment END AS creator_id FROM customer)"


def _customers(spark, d):
    c = B.table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lower("c_mktsegment"), (F.col("c_nationkey") % 9).cast("string")).alias("creator"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("id"), (F.col("c_nationkey") % 2).cast("string"), "c_mktsegment")).alias("creator_id"))


@R.add(f"""WITH {_CUST}, i AS (SELECT creator, count(DISTINCT creator_id) AS n, min(creator_id) AS one FROM cu WHERE creator_id IS NOT NULL GROUP BY creator)
    SELECT c_custkey, coalesce(creator_id, CASE WHEN n = 1 THEN one END) AS creator_key, CASE WHEN creator_id IS NOT NULL THEN 'given' WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS creator_status FROM cu LEFT JOIN i USING (creator)""")
def f8_resolve_creator(spark, d):
    return P.resolve_creator(_customers(spark, d)).select("c_custkey", "creator_key", "creator_status")


_F9 = """SELECT CASE WHEN NOT coalesce(complete, false) THEN 'incomplete' WHEN n = 0 THEN 'unlabelled' WHEN n > 1 THEN 'multi-label' WHEN pair_class IN ('conflict', 'unknown') THEN 'invalid' WHEN st = 'unknown' THEN 'unknown creator' WHEN trim(ctx) = '' THEN 'invalid context' ELSE 'kept' END AS reason FROM
  (SELECT o_orderstatus <> 'P' AS complete, o_orderkey % 4 AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'synthetic' END AS pair_class, CASE WHEN o_custkey % 7 = 0 THEN 'unknown' ELSE 'given' END AS st, CASE WHEN o_custkey % 11 = 0 THEN ' ' ELSE o_orderpriority END AS ctx FROM orders)"""


@R.add(f"SELECT reason, count(*) AS n FROM ({_F9}) GROUP BY reason")
def f9_build_labeled(spark, d):
    o = B.table(spark, d, "orders")
    labels = F.slice(F.array(*map(F.lit, "abc")), 1, (F.col("o_orderkey") % 4).cast("int"))
    rows = o.select((F.col("o_orderstatus") != "P").alias("complete"), labels.alias("labels"), F.when(F.col("o_orderkey") % 5 == 0, "conflict").otherwise("synthetic").alias("pair_class"), F.when(F.col("o_custkey") % 7 == 0, "unknown").otherwise("given").alias("creator_status"), F.when(F.col("o_custkey") % 11 == 0, " ").otherwise(F.col("o_orderpriority")).alias("context"))
    return P.build_labeled(rows)[1]


@R.add("SELECT source AS creator_key, count(*) AS rows, count(DISTINCT doc_id) AS fixtures, (('0x' || substr(sha256(source), 1, 8))::BIGINT % 5)::INT AS fold FROM documents GROUP BY source")
def f10_creator_groups(spark, d):
    return P.creator_groups(B.table(spark, d, "documents").select(F.col("source").alias("creator_key"), F.col("doc_id").alias("fixture")))


@R.add(r"""SELECT context_key, count(*) AS n, count(DISTINCT source) AS creators, count(DISTINCT ('0x' || substr(sha256(source), 1, 8))::BIGINT % 5) AS folds FROM
    (SELECT source, lower(trim(regexp_replace(replace(unnest(string_split(text, chr(10))), chr(160), ' '), '\s+', ' ', 'g'))) AS context_key FROM documents) GROUP BY context_key HAVING count(DISTINCT source) > 1""")
def f11_context_leakage(spark, d):
    return P.context_leakage(B.table(spark, d, "documents").select(F.col("source").alias("creator_key"), F.explode(F.split("text", "\n")).alias("context")))


@R.add(f"WITH {_ROWS} SELECT sum(n)::BIGINT AS input, count(*) AS retained, sum(n - o)::BIGINT AS repeats, count(*) FILTER (o > 1) AS conflicts FROM (SELECT count(*) AS n, count(DISTINCT observation) AS o FROM rws GROUP BY fixture, slot)")
def f12_duplicate_diagnostics(spark, d):
    return P.duplicate_diagnostics(_rows(spark, d))


_MAN = "man AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'id' || n_nationkey END AS creator_id, CASE n_nationkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'other' END AS split FROM nation)"


def _manifest(spark, d):
    n, k = B.table(spark, d, "nation"), F.col("n_nationkey")
    return n.select(F.col("n_name").alias("name"), F.when(k % 3 > 0, F.concat(F.lit("id"), k.cast("string"))).alias("creator_id"), F.when(k % 4 == 0, "train").when(k % 4 == 1, "validation").when(k % 4 == 2, "test").otherwise("other").alias("split"), F.lit("2020-01-01").cast("timestamp").alias("frozen_at"))


@R.add(f"""WITH {_MAN} SELECT c_custkey, CASE WHEN a.split <> b.split THEN 'conflict' ELSE coalesce(a.split, b.split, 'unknown') END AS split FROM (SELECT c_custkey, 'id' || c_nationkey AS creator_id, CASE WHEN c_custkey % 5 > 0 THEN n_name END AS nm FROM customer LEFT JOIN nation ON n_nationkey = (c_nationkey + c_custkey % 2) % 25) c
    LEFT JOIN man a ON a.creator_id = c.creator_id LEFT JOIN man b ON lower(b.name) = lower(c.nm)""")
def f13_assign_split(spark, d):
    names = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nm"))
    c = B.table(spark, d, "customer").withColumn("k", (F.col("c_nationkey") + F.col("c_custkey") % 2) % 25).join(names, "k", "left")
    rows = c.select("c_custkey", F.concat(F.lit("id"), F.col("c_nationkey").cast("string")).alias("creator_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("nm")).alias("creator"))
    return P.assign_split(rows, _manifest(spark, d)).select("c_custkey", "split")


@R.add(f"WITH {_MAN} SELECT name, 'split' AS violation FROM man WHERE split = 'other' UNION ALL SELECT name, 'test without id' FROM man WHERE split = 'test' AND creator_id IS NULL")
def f14_validate_manifest(spark, d):
    return P.validate_manifest(_manifest(spark, d))


@R.add("SELECT c_mktsegment AS split, count(DISTINCT c_nationkey) AS creators, sum(c_custkey % 5)::BIGINT AS slots, count(DISTINCT c_nationkey) >= 25 AND sum(c_custkey % 5) >= 600 AS enough FROM customer GROUP BY c_mktsegment")
def f15_prospective_minimums(spark, d):
    return P.prospective_minimums(B.table(spark, d, "customer").select(F.col("c_mktsegment").alias("split"), F.col("c_nationkey").alias("creator_key"), (F.col("c_custkey") % 5).alias("slots")), 25, 600)


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def f16_exclude_heldout(spark, d):
    return P.exclude_heldout(B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@R.add(f"""WITH {_ITEMS}, g AS (SELECT id, count(DISTINCT pair_class) > 1 OR count(DISTINCT creator_id) > 1 OR count(creator_id) = 0 AND count(DISTINCT lower(creator)) > 1 OR count(DISTINCT manual_path) > 1 AS q FROM items GROUP BY id),
    x AS (SELECT p_partkey AS id, (p_size % 3)::INT AS token_index, CASE WHEN p_size % 2 = 0 THEN p_brand END AS e, CASE WHEN p_size % 5 > 0 THEN p_type END AS o FROM part)
    SELECT x.id, token_index, CASE WHEN NOT coalesce(q, false) THEN coalesce(e, o) END AS expected, CASE WHEN coalesce(q, false) OR coalesce(e, o) IS NULL THEN 'unknown' WHEN e IS NOT NULL THEN 'direct' ELSE 'aligned' END AS label_source FROM x LEFT JOIN g ON x.id = g.id""")
def f17_build_discovery(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).cast("int").alias("token_index"), "p_size", "p_brand", "p_type")
    direct = p.select("id", "token_index", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("expected"))
    aligned = p.where("p_size % 5 > 0").select("id", "token_index", F.col("p_type").alias("expected"))
    return P.build_discovery(direct, aligned, P.source_groups(_items(spark, d)))


@R.add("SELECT event_type AS tier, user_id::VARCHAR AS expected, event_id AS row_id FROM events")
def f18_index_by_word(spark, d):
    return P.index_by_word(B.table(spark, d, "events").select(F.col("event_type").alias("tier"), F.col("user_id").cast("string").alias("expected"), F.col("event_id").alias("row_id")))


@R.add("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM n WHERE p IN (SELECT floor(i * (n - 1)::DOUBLE / 99 + 0.5) FROM (SELECT unnest(range(0, 100)) AS i), (SELECT max(n) AS n FROM n))")
def i1_distributed_sample(spark, d):
    return I.distributed_sample(B.table(spark, d, "orders"), 100, "o_totalprice", "o_orderkey").select("o_orderkey")


@R.add("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS t FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY t, c_nationkey, c_custkey) AS r FROM t)
    SELECT c_custkey, r::INT AS round FROM r ORDER BY r, c_mktsegment LIMIT 200""")
def i2_round_robin_sample(spark, d):
    return I.round_robin_sample(B.table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_custkey", 200).select("c_custkey", "round")


@R.add("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + c_nationkey % 3 AS r FROM customer) SELECT c_custkey FROM r ORDER BY r, c_nationkey, c_custkey LIMIT 150""")
def i3_balanced_take(spark, d):
    c = B.table(spark, d, "customer")
    return I.balanced_take(c, "c_nationkey", "c_custkey", 150, c.select("c_nationkey", (F.col("c_nationkey") % 3).alias("n")).distinct()).select("c_custkey")


@R.add("SELECT 'c_mktsegment' AS dimension, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_custkey < 10) AS covered, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS candidates UNION ALL SELECT 'c_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_custkey < 10), (SELECT count(DISTINCT c_nationkey) FROM customer)")
def i4_sample_coverage(spark, d):
    c = B.table(spark, d, "customer")
    return I.sample_coverage(c.where("c_custkey < 10"), c, "c_mktsegment", "c_nationkey")


_I5 = "CASE event_type WHEN 'error' THEN 'disagreement' WHEN 'view' THEN 'both-empty' ELSE event_type END"


@R.add(f"""WITH e AS (SELECT event_id, {_I5} AS category FROM events), c AS (SELECT category, count(*) AS n FROM e GROUP BY 1),
    q AS (SELECT (SELECT least(coalesce(max(n), 0), 3000) FROM c WHERE category = 'disagreement') AS w, (SELECT least(coalesce(max(n), 0), 100) FROM c WHERE category = 'both-empty') AS b)
    SELECT event_id, category FROM (SELECT event_id, category, row_number() OVER (PARTITION BY category ORDER BY event_id) AS k, (SELECT w FROM q) AS w, (SELECT least(b, 3000 - w) FROM q) AS b FROM e)
    WHERE k <= CASE category WHEN 'disagreement' THEN w WHEN 'both-empty' THEN b ELSE (3000 - w - b) // 3 + CASE WHEN (3000 - w - b) % 3 > 0 AND category = (SELECT category FROM c WHERE category NOT IN ('disagreement', 'both-empty') ORDER BY n DESC, category DESC LIMIT 1) THEN 1 ELSE 0 END
      + CASE WHEN (3000 - w - b) % 3 > 1 AND category = (SELECT category FROM c WHERE category NOT IN ('disagreement', 'both-empty') ORDER BY n DESC, category DESC LIMIT 1 OFFSET 1) THEN 1 ELSE 0 END END""")
def i5_triage_queue(spark, d):
    kind = F.when(F.col("event_type") == "error", "disagreement").when(F.col("event_type") == "view", "both-empty").otherwise(F.col("event_type"))
    return I.triage_queue(B.table(spark, d, "events").select("event_id", kind.alias("category")), "category", "event_id", 3000, 100)


@R.add("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'control' ELSE 'review' END AS kind FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY kind, user_id ORDER BY event_id) AS t FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY t, user_id, event_id) AS k FROM t) SELECT event_id, kind FROM r WHERE k <= CASE kind WHEN 'control' THEN 100 WHEN 'review' THEN 50 ELSE 850 END""")
def i6_failure_triage(spark, d):
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "control").otherwise("review")
    return I.failure_triage(B.table(spark, d, "events").select("event_id", "user_id", kind.alias("kind")), "kind", "user_id", "event_id", 1000).select("event_id", "kind")


@R.add("SELECT c_custkey, (row_number() OVER (ORDER BY sha256(c_custkey::VARCHAR), c_custkey) - 1)::BIGINT AS position FROM customer")
def i7_hash_shuffle(spark, d):
    rows = B.table(spark, d, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"))
    return I.numbered(rows, "h", "c_custkey").select("c_custkey", "position")


@R.add("SELECT user_id, event_id, k::INT AS k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error')::INT DESC, event_id) AS k FROM events) WHERE k <= 8")
def i8_top_examples(spark, d):
    return I.top_examples(B.table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("counter")), "user_id", "counter", "event_id").select("user_id", "event_id", "k")


@R.add("SELECT c_custkey AS k, c_name AS name, NULL::INT AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def j1_union(spark, d):
    return I.union_all(B.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), B.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))


@R.add("SELECT count(*) AS shared FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer)")
def j2_intersect(spark, d):
    return I.intersect_counts(B.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), B.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@R.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j3_except(spark, d):
    return I.except_keys(B.table(spark, d, "customer").select("c_custkey"), B.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@R.add("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def j4_distinct_first(spark, d):
    return I.distinct_first(B.table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


# Review: users are fixtures, k of props is the slot, events in order are annotations.
_ANN = "ann AS (SELECT user_id AS fixture, CASE WHEN event_id % 50 > 0 THEN user_id || ':' || event_id % 9 END AS slot_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'labeled' WHEN 'click' THEN 'corrected' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'odd' END ELSE 'pending' END AS status, CASE WHEN event_id % 4 > 0 THEN 'w' || event_id % 7 END AS word FROM events)"


def _annotations(spark, d):
    e, k = B.table(spark, d, "events"), F.col("event_id")
    return e.select(F.col("user_id").alias("fixture"), F.when(k % 50 > 0, F.concat_ws(":", F.col("user_id").cast("string"), (k % 9).cast("string"))).alias("slot_id"), k.alias("seq"), F.when(F.col("event_type") == "view", "labeled").when(F.col("event_type") == "click", "corrected").when(F.col("event_type") == "error", F.when(k % 3 == 0, "rejected").otherwise("odd")).otherwise("pending").alias("status"), F.when(k % 4 > 0, F.concat(F.lit("w"), (k % 7).cast("string"))).alias("word"))


_MODES = """am AS (SELECT l_orderkey AS track_id, l_linenumber AS token_index, max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS word, max(l_tax) AS time_s FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), bm AS (SELECT l_orderkey AS track_id, l_linenumber AS token_index, min(CASE WHEN l_returnflag <> 'R' THEN l_returnflag END) AS word, max(l_discount) + 0.05 AS time_s FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL),
  cmp AS (SELECT track_id, token_index, a.word AS a_word, b.word AS b_word, CASE WHEN a.word IS NULL AND b.word IS NULL THEN 'both-empty' WHEN b.word IS NULL THEN 'only-a' WHEN a.word IS NULL THEN 'only-b' WHEN a.word = b.word THEN 'agreement' ELSE 'disagreement' END AS category, coalesce(abs(a.time_s - b.time_s) > 0.1, false) AS apart FROM am a FULL JOIN bm b USING (track_id, token_index))"""


def _modes(spark, d):
    li = B.table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "track_id", "l_linenumber": "token_index"})
    a = li.where("l_linestatus = 'F'").groupBy("track_id", "token_index").agg(F.max(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("word"), F.max("l_tax").alias("time_s"))
    b = li.where("l_partkey % 2 = 0").groupBy("track_id", "token_index").agg(F.min(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))).alias("word"), (F.max("l_discount") + 0.05).alias("time_s"))
    return V.compare_modes(a, b)


@R.add(f"WITH {_MODES} SELECT * FROM cmp")
def e14_compare_modes(spark, d):
    return _modes(spark, d)


@R.add(f"WITH {_MODES} SELECT track_id, token_index FROM cmp WHERE category <> 'agreement'")
def m1_review_queue(spark, d):
    return V.review_queue(_modes(spark, d), "triage").select("track_id", "token_index")


# 3,000 slots: all disagreements that fit, 25 empty ones, one-sided ones by halves.
@R.add(f"""WITH {_MODES}, n AS (SELECT count(*) FILTER (category = 'disagreement') AS d, count(*) FILTER (category = 'both-empty') AS e, count(*) FILTER (category = 'only-a') AS a, count(*) FILTER (category = 'only-b') AS b FROM cmp),
    n2 AS (SELECT *, least(d, 3000) AS td, least(e, 25, 3000 - least(d, 3000)) AS te FROM n), n3 AS (SELECT *, 3000 - td - te AS rest FROM n2), n4 AS (SELECT *, least(b, rest - least(a, (rest + 1) // 2)) AS tb FROM n3),
    quota AS (SELECT unnest([('disagreement', td), ('both-empty', te), ('only-b', tb), ('only-a', least(a, rest - tb))], recursive := true) FROM n4),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY turn, track_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY category, track_id ORDER BY token_index) AS turn FROM cmp))
    SELECT track_id, token_index, r.category FROM ranked r JOIN quota q(category, n) ON r.category = q.category AND k <= n""")
def m1_triage_limits(spark, d):
    return V.limited_queue(_modes(spark, d), "triage", 3000).select("track_id", "token_index", "category")


@R.add(f"""WITH {_ANN}, l AS (SELECT fixture, slot_id, arg_max(status, seq) AS status, arg_max(coalesce(word, chr(1)), seq) AS word FROM ann WHERE slot_id IS NOT NULL AND status IN ('labeled', 'corrected', 'rejected') GROUP BY ALL)
    SELECT fixture, slot_id, nullif(word, chr(1)) AS word FROM l WHERE status <> 'rejected' AND fixture NOT IN (SELECT fixture FROM ann WHERE slot_id IS NULL AND status = 'rejected')""")
def m2_annotation_history(spark, d):
    return V.annotation_history(_annotations(spark, d))


@R.add(f"WITH {_ANN} SELECT seq, CASE WHEN a.status = 'pending' AND f.fs IS NOT NULL THEN f.fs ELSE a.status END AS status FROM ann a LEFT JOIN (SELECT fixture, min(status) AS fs FROM ann WHERE slot_id IS NULL GROUP BY fixture) f USING (fixture)")
def m3_propagate_label(spark, d):
    rows = _annotations(spark, d)
    whole = rows.where("slot_id IS NULL").groupBy("fixture").agg(F.min("status").alias("fixture_status"))
    return V.propagate_label(rows, whole).select("seq", "status")


@R.add(B.sql("slots", body="SELECT track_id, token_index FROM slots WHERE (track_id, event_index) IN (SELECT (track_id, event_index) FROM slots WHERE token_index % 5 = 0)"))
def m4_group_by_caption(spark, d):
    s = B.slots(spark, d)
    return V.group_by_caption(s.where("token_index % 5 = 0"), s).select("track_id", "token_index")


@R.add(f"""WITH {_ANN} SELECT slot_id, seq, 'status' AS violation FROM ann WHERE status = 'odd' UNION ALL SELECT slot_id, seq, 'label without word' FROM ann WHERE status IN ('labeled', 'corrected') AND word IS NULL UNION ALL SELECT slot_id, seq, 'word without label' FROM ann WHERE status NOT IN ('labeled', 'corrected') AND word IS NOT NULL""")
def m5_validate_annotations(spark, d):
    return V.validate_annotations(_annotations(spark, d))


_M5B = "cur AS (SELECT event_id // 4 AS event, event_id::VARCHAR AS slot_id, event_type AS word, event_id % 6 = 0 AS reviewed FROM events), bat AS (SELECT event_id::VARCHAR AS slot_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'x' END AS previous, 'new' AS word FROM events WHERE event_id % 40 > 3)"


@R.add(f"WITH {_M5B}, j AS (SELECT c.event, c.slot_id, c.word, b.word AS nw, b.word IS NOT NULL AND (NOT reviewed OR previous = c.word) AS fine FROM cur c LEFT JOIN bat b USING (slot_id)) SELECT event, slot_id, CASE WHEN bool_and(fine) OVER w THEN nw ELSE word END AS word, bool_and(fine) OVER w AS applied FROM j WINDOW w AS (PARTITION BY event)")
def m5b_apply_label_batch(spark, d):
    e, k = B.table(spark, d, "events"), F.col("event_id")
    cur = e.select(F.floor(k / 4).cast("bigint").alias("event"), k.cast("string").alias("slot_id"), F.col("event_type").alias("word"), (k % 6 == 0).alias("reviewed"))
    bat = e.where(k % 40 > 3).select(k.cast("string").alias("slot_id"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise("x").alias("previous"), F.lit("new").alias("word"))
    return V.apply_label_batch(cur, bat)


@R.add("SELECT slot_id, CASE WHEN same THEN w END AS word, CASE WHEN n IS NULL THEN 'gone' WHEN o IS NOT NULL AND NOT same THEN 'changed' END AS violation FROM (SELECT coalesce(a.k, b.k) AS slot_id, a.o, b.n, a.o = b.n AS same, w FROM (SELECT c_custkey AS k, c_nationkey AS o, c_name AS w FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS n FROM customer WHERE c_custkey % 4 > 0) b USING (k))")
def m5c_resume_queue(spark, d):
    c = B.table(spark, d, "customer")
    old = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("slot_id"), "c_nationkey", F.col("c_name").alias("word"))
    new = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("slot_id"), F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return V.resume_queue(old, new, ["c_nationkey"])


@R.add("SELECT event_id AS slot_id, event_type AS human, 'click' AS alt, CASE WHEN event_type IN ('view', 'click') THEN 'form' WHEN event_type = 'error' THEN 'swap' ELSE 'word-or-span' END AS kind, greatest(value - 3, 0) AS from_s, value + 3 AS to_s FROM events")
def m6_label_audit_queue(spark, d):
    families = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(f).alias("family")) for w, f in (("view", "use"), ("click", "use"), ("error", "fault"))])).alias("f")).select("f.*")
    return V.label_audit_queue(B.table(spark, d, "events").select(F.col("event_id").alias("slot_id"), F.col("value").alias("time_s"), F.col("event_type").alias("human"), F.lit("click").alias("alt")), families)


@R.add("SELECT user_id AS id, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS status, arg_max(event_type, event_id) FILTER (event_id % 2 = 1) AS pattern, coalesce(arg_max(event_id % 3, event_id) FILTER (event_id % 2 = 0) <> 1, false) AS stale FROM events GROUP BY user_id")
def m7_review_state(spark, d):
    e, k = B.table(spark, d, "events"), F.col("event_id")
    return V.review_state(e.select(F.col("user_id").alias("id"), k.alias("seq"), F.when(k % 2 == 0, "review").otherwise("custom").alias("type"), F.col("event_type").alias("status"), F.col("event_type").alias("pattern"), F.lit("t").alias("target"), (k % 3).cast("string").alias("stale_hash")), "1")


@R.add("SELECT o_custkey AS lead, o_orderkey AS row_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def m8_dangling_references(spark, d):
    leads = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("lead")).agg(F.collect_list("o_orderkey").alias("example_ids"))
    return V.dangling_references(leads, B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id")))


@R.add("SELECT o_orderkey AS slot_id, CASE WHEN c = 1 AND abs(0.02 - t) <= 0.1 THEN x END AS text, CASE WHEN c > 1 THEN 'repeated' WHEN abs(0.02 - t) > 0.1 THEN 'time' END AS refused FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c, min(l_returnflag) AS x, min(l_tax) * 2 AS t FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def m9_attach_external(spark, d):
    slots = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("slot_id"), F.lit(0.02).alias("time_s"))
    return V.attach_external(slots, B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slot_id"), F.col("l_returnflag").alias("text"), (F.col("l_tax") * 2).alias("time_s")))


@R.add("SELECT p_brand AS pair_class, count(*) AS items, sum(p_size)::BIGINT AS slots FROM part GROUP BY p_brand")
def n1_item_summary(spark, d):
    return N.item_summary(B.table(spark, d, "part").select(F.col("p_brand").alias("pair_class"), F.col("p_size").alias("slots")))


def _status(spark, d):
    return B.table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 3).alias("check_type"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))


@R.add("SELECT user_id AS id, event_id % 3 AS check_type, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) IN ('error', 'view')")
def n2_check_ledger(spark, d):
    return N.check_ledger(_status(spark, d), ["error", "view"])


@R.add("SELECT user_id AS id, event_id % 3 AS check_type FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) NOT IN ('error', 'view')")
def n2_to_check(spark, d):
    rows = _status(spark, d)
    return N.to_check(rows.select("id", "check_type").distinct(), N.check_ledger(rows, ["error", "view"]))


@R.add("SELECT user_id AS id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3")
def n3_abandoned(spark, d):
    return N.abandoned(_status(spark, d), ["error"])


@R.add("SELECT user_id AS id, CASE WHEN user_id % 10 = 0 THEN 'unavailable' WHEN count(*) FILTER (event_type = 'purchase') >= 20 THEN 'target' WHEN count(*) >= 80 THEN 'checked' WHEN sum(value) >= 0.99 * 800 THEN 'slots' WHEN count(*) FILTER (event_type = 'signup') = 0 THEN 'settled' END AS finished FROM events GROUP BY user_id")
def n4_budget_met(spark, d):
    e = B.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("event_type") == "purchase").alias("saved"), F.count("*").alias("checked"), F.sum("value").alias("slots"), F.count_if(F.col("event_type") == "signup").alias("open"))
    return N.budget_met(e.withColumns({"available": F.col("id") % 10 != 0, "target": F.lit(20), "most": F.lit(80), "cap": F.lit(800)})).select("id", "finished")


@R.add("""WITH c AS (SELECT s_name AS name, s_suppkey % 90 AS cid, s_suppkey % 7 AS k, s_suppkey % 11 AS p FROM supplier) SELECT name, 'no sources' AS violation FROM c WHERE k = 0 UNION ALL SELECT name, 'prospective without id' FROM c WHERE p = 0 AND cid % 2 = 0
    UNION ALL SELECT min(name), 'repeated id' FROM c WHERE cid % 2 = 1 GROUP BY cid HAVING count(*) > 1""")
def n5_validate_channels(spark, d):
    k = F.col("s_suppkey")
    return N.validate_channels(B.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when((k % 90) % 2 == 1, k % 90).alias("channel_id"), F.slice(F.array(*map(F.lit, "abcdef")), 1, (k % 7).cast("int")).alias("sources"), (k % 11 == 0).alias("prospective")))


@R.add("""WITH o AS (SELECT o_custkey AS source, count(*) AS slots FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS source, count(*) AS slots, bool_or(o_orderstatus = 'P') AS qc, max(o_orderkey) AS fp FROM orders GROUP BY 1)
    SELECT source, n.slots - coalesce(o.slots, 0) AS gained, (n.slots - coalesce(o.slots, 0) >= 6 OR qc) AND source % 4 > 0 AND (o.slots IS NULL OR fp % 2 = 1) AS refresh FROM n LEFT JOIN o USING (source)""")
def n6_refresh_decision(spark, d):
    o = B.table(spark, d, "orders").withColumnRenamed("o_custkey", "source")
    make = lambda df: df.groupBy("source").agg(F.count("*").alias("slots"), F.bool_or(F.col("o_orderstatus") == "P").alias("queue_complete"), F.max("o_orderkey").cast("string").alias("fingerprint"))
    now = make(o).withColumn("evidence", F.when(F.col("source") % 4 > 0, "complete").otherwise("incomplete"))
    return N.refresh_decision(make(o.where("o_orderkey % 2 = 0")), now, 6)


@R.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'existing' WHEN o_orderstatus = 'P' THEN 'no-manual' WHEN o_custkey % 6 = 0 THEN 'no-automatic' WHEN o_custkey % 7 = 0 THEN 'already-masked' WHEN o_orderkey % 5 = 0 THEN 'no-slots' WHEN o_orderkey % 5 > 3 THEN 'cap' ELSE 'saved' END AS status FROM orders")
def n7_acquire_status(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return N.acquire_status(B.table(spark, d, "orders").select(k.alias("id"), (k % 13 == 0).alias("exists"), (F.col("o_orderstatus") != "P").alias("has_manual"), (c % 6 != 0).alias("has_automatic"), (c % 7 == 0).alias("masked_already"), (k % 5).alias("slots"), F.lit(3).alias("cap"))).select("id", "status")
