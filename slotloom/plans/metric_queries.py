"""Queries over the metrics (G) and scored-candidate decisions (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotloom.operators import metrics as M
from slotloom.operators import rules as U
from slotloom.operators import scored as L
from slotloom.plans import base as B
from slotloom.plans import rule_queries as Q
from slotloom.plans.registry import Registry

R = Registry(share=True)
_FLAG = "count(*) AS slots, count(*) FILTER (expected IS NOT NULL) AS scored, count(*) FILTER (word IS NOT NULL) AS attempted, count(*) FILTER (word = expected) AS correct"
_RATES = "CASE WHEN attempted > 0 THEN correct::DOUBLE / attempted END AS precision, CASE WHEN scored > 0 THEN correct::DOUBLE / scored END AS coverage"
_RM = "rm AS (SELECT rule_id, count(*) AS matched, count(word) AS attempted, count(*) FILTER (word = expected) AS correct, count(*) FILTER (list_contains(candidates, expected)) AS candidate_correct, max(len(candidates))::INT AS max_candidates, count(DISTINCT creator) AS creators FROM predictions WHERE rule_id IS NOT NULL GROUP BY rule_id)"
_ALT = "alt AS MATERIALIZED (SELECT m.track_id, m.token_index, m.creator, m.ord, m.rule_id, m.expected, CASE WHEN len(m.candidates) = 1 THEN m.candidates[1] ELSE word END AS word FROM matches m JOIN priors USING (rule_id))"
_LOO = _ALT + """, nx AS (SELECT *, row_number() OVER w AS k, lead(rule_id) OVER w AS nr, lead(word) OVER w AS nw FROM alt WINDOW w AS (PARTITION BY track_id, token_index ORDER BY ord, rule_id)),
  fl AS (SELECT *, coalesce(word = expected, false) AS a, coalesce(nw = expected, false) AS b, word IS NOT NULL AND word <> expected AS x, nw IS NOT NULL AND nw <> expected AS y FROM nx WHERE k = 1),
  loo AS (SELECT rule_id, count(*) AS won, count(*) FILTER (a AND NOT b) AS correct_lost, count(*) FILTER (NOT a AND b) AS correct_gained, count(*) FILTER (x AND NOT y) AS wrong_avoided, count(*) FILTER (NOT x AND y) AS wrong_introduced FROM fl GROUP BY rule_id)"""
_AUD = _LOO + """, tr AS (SELECT m.rule_id, m.creator, m.expected, row_number() OVER (PARTITION BY m.track_id, m.token_index ORDER BY m.ord, m.rule_id) = 1 AS won, a.word FROM matches m JOIN alt a USING (track_id, token_index, rule_id)),
  aud AS (SELECT rule_id, count(*) AS matched, count(*) FILTER (won) AS scored, count(*) FILTER (won AND word IS NOT NULL) AS attempted, count(*) FILTER (won AND word = expected) AS correct, count(*) FILTER (won AND word IS NULL) AS abstained, count(DISTINCT creator) AS creators FROM tr GROUP BY rule_id)"""


def _q(body: str, more: str = "") -> str:
    return B.sql("features", more=Q.DECIDED + (", " + more if more else ""), body=body)


def _alternatives(spark, d):
    found = Q.matches(spark, d)
    return U.decide(found, U.estimate_priors(found))


def _loo(spark, d):
    return M.leave_one_out(_alternatives(spark, d))


def _audit(spark, d):
    alt = _alternatives(spark, d)
    status = U.trace(alt.select("track_id", "token_index").distinct(), alt.select("track_id", "token_index", "rule_id", "ord", "candidates")).select("track_id", "token_index", "rule_id", "status")
    return M.rule_audit(alt.join(status, ["track_id", "token_index", "rule_id"]))


@R.add(_q(f"SELECT *, {_RATES} FROM (SELECT {_FLAG} FROM predictions)"))
def g1_summarize(spark, d):
    return M.summarize(Q.predictions(spark, d))


@R.add(_q(f"SELECT *, {_RATES} FROM (SELECT CASE WHEN grouping(pair_class) = 0 THEN 'pair_class' WHEN grouping(creator) = 0 THEN 'creator' ELSE 'all' END AS dimension, coalesce(pair_class, creator) AS value, {_FLAG} FROM predictions GROUP BY GROUPING SETS ((), (pair_class), (creator)))"))
def g2_by_pair_class_and_creator(spark, d):
    return M.by_sets(Q.predictions(spark, d), "pair_class", "creator")


@R.add(_q(f"SELECT pair_class, avg(precision) AS macro_precision, avg(coverage) AS macro_coverage, count(*) AS creators FROM (SELECT *, {_RATES} FROM (SELECT pair_class, creator, {_FLAG} FROM predictions WHERE creator IS NOT NULL GROUP BY ALL)) GROUP BY pair_class"))
def g3_creator_macro(spark, d):
    return M.creator_macro(Q.predictions(spark, d), "pair_class")


@R.add(_q("SELECT * FROM rm", _RM))
def g4_rule_metrics(spark, d):
    return M.rule_metrics(Q.predictions(spark, d))


@R.add(_q("SELECT * FROM rm", _RM.replace("SELECT rule_id,", "SELECT rule_id, pair_class,").replace("GROUP BY rule_id", "GROUP BY rule_id, pair_class")))
def g4_rule_metrics_by_class(spark, d):
    return M.rule_metrics(Q.predictions(spark, d), "pair_class")


@R.add(_q("SELECT rule_id, CASE WHEN matched < CASE WHEN max_candidates > 1 THEN 8 ELSE 4 END THEN 'support' WHEN creators < 2 THEN 'creators' WHEN attempted = 0 OR correct::DOUBLE / attempted < 0.9 THEN 'precision' ELSE 'pass' END AS verdict FROM rm", _RM))
def g5_quality_gate(spark, d):
    return M.quality_gate(M.rule_metrics(Q.predictions(spark, d))).select("rule_id", "verdict")


@R.add(_q("SELECT CASE WHEN expected IS NULL THEN 'unscored' WHEN word IS NULL THEN 'missed' WHEN word = expected THEN 'correct' ELSE 'different' END AS classification, count(*) AS n FROM predictions GROUP BY 1"))
def g6_classify(spark, d):
    return M.classify(Q.predictions(spark, d)).groupBy("classification").agg(F.count("*").alias("n"))


@R.add(_q("SELECT expected, word AS predicted, count(*) AS n FROM predictions WHERE word <> expected GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 50"))
def g7_top_confusions(spark, d):
    return M.top_confusions(Q.predictions(spark, d))


@R.add(_q("SELECT track_id, count(*) AS slots, count(word) AS aligned, count(word)::DOUBLE / count(*) AS alignment_rate, count(word)::DOUBLE / count(*) < 0.5 AS review FROM predictions GROUP BY track_id"))
def g8_track_report(spark, d):
    return M.track_report(Q.predictions(spark, d).select("track_id", F.col("word").alias("expected")))


@R.add(_q(f"SELECT *, {_RATES} FROM (SELECT {_FLAG} FROM (SELECT expected, CASE WHEN list_contains(candidates, expected) THEN expected ELSE candidates[1] END AS word FROM predictions))"))
def g9_oracle_score(spark, d):
    return M.oracle_score(Q.predictions(spark, d))


@R.add(_q("SELECT pair_class, creator, count(expected) AS labelled, count(*) - count(expected) AS unlabelled, count(word) AS predicted, count(DISTINCT track_id) AS tracks FROM predictions GROUP BY ALL"))
def g10_replay_stats(spark, d):
    return M.replay_stats(Q.predictions(spark, d))


@R.add(B.sql("labelled", body="SELECT pair_class, expected, count(*) AS n, count(DISTINCT creator) AS creators, expected IN ('this', 'that', 'these') AS known FROM labelled GROUP BY ALL UNION ALL SELECT NULL, 'these', 0, 0, true"))
def g11_vocabulary_audit(spark, d):
    lex = spark.range(1).select(F.explode(F.array(*map(F.lit, ["this", "that", "these"]))).alias("word"))
    return M.vocabulary_audit(B.labelled(spark, d), lex)


@R.add(B.sql("labelled", body="SELECT DISTINCT expected AS word FROM labelled WHERE pair_class = 'manual-auto' AND expected <> 'from'"))
def g12_vocabulary_candidates(spark, d):
    visible = B.masked(spark, d).select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word"))
    return M.vocabulary_candidates(B.labelled(spark, d), visible, B.lexicon(spark).where("word = 'from'"))


@R.add(_q("SELECT rule_id, round(CASE WHEN attempted > 0 THEN (correct / attempted + 3.8416 / (2 * attempted) - 1.96 * sqrt((correct / attempted * (1 - correct / attempted) + 3.8416 / (4 * attempted)) / attempted)) / (1 + 3.8416 / attempted) ELSE 0 END, 9) + 0.0 AS wilson FROM (SELECT rule_id, correct::DOUBLE AS correct, attempted::DOUBLE AS attempted FROM rm)", _RM))
def g13_wilson_lower(spark, d):
    return M.wilson(M.rule_metrics(Q.predictions(spark, d))).select("rule_id", (F.round("wilson", 9) + 0.0).alias("wilson"))


@R.add(_q("""SELECT a.*, h.expected_counts, CASE WHEN h.expected_counts IS NOT NULL THEN coalesce(p.predicted_counts, []) END AS predicted_counts FROM aud a LEFT JOIN (SELECT rule_id, list(e ORDER BY e) AS expected_counts FROM (SELECT rule_id, expected || '=' || count(*) AS e FROM tr WHERE won GROUP BY rule_id, expected) GROUP BY rule_id) h USING (rule_id)
    LEFT JOIN (SELECT rule_id, list(e ORDER BY e) AS predicted_counts FROM (SELECT rule_id, word || '=' || count(*) AS e FROM tr WHERE won AND word IS NOT NULL GROUP BY rule_id, word) GROUP BY rule_id) p USING (rule_id)""", _AUD))
def g14_rule_audit(spark, d):
    return _audit(spark, d)


@R.add(_q("SELECT * FROM loo", _LOO))
def g15_leave_one_out(spark, d):
    return _loo(spark, d)


@R.add(_q("""SELECT rule_id, (c - correct_lost + correct_gained)::DOUBLE / (a - wrong_avoided + wrong_introduced - correct_lost + correct_gained) AS precision_without, (c - correct_lost + correct_gained)::DOUBLE / s AS coverage_without
    FROM loo, (SELECT count(*) AS s, count(word) AS a, count(*) FILTER (word = expected) AS c FROM predictions)""", _LOO))
def g16_audit_deltas(spark, d):
    return M.audit_deltas(_loo(spark, d), M.summarize(Q.predictions(spark, d)))


@R.add(_q("""SELECT rule_id, CASE WHEN won IS NULL OR won = 0 THEN 'retire' WHEN attempted = 0 THEN 'abstain' WHEN correct_lost = 0 AND wrong_avoided > 0 THEN 'remove' WHEN wrong_avoided > correct_lost THEN 'remove'
    WHEN correct::DOUBLE / attempted < 0.7 THEN 'narrow' WHEN attempted < 4 THEN 'candidate' ELSE 'keep' END AS advice FROM aud LEFT JOIN loo USING (rule_id)""", _AUD))
def g17_recommend(spark, d):
    return M.recommend(_audit(spark, d).join(_loo(spark, d), "rule_id", "left")).select("rule_id", "advice")


@R.add(_q("SELECT rule_id AS from_rule, nr AS to_rule, count(*) AS n, count(DISTINCT creator) AS creators FROM nx WHERE k = 1 AND nr IS NOT NULL GROUP BY ALL", _LOO))
def g18_rule_overlap_graph(spark, d):
    return M.rule_overlap_graph(_alternatives(spark, d))


@R.add(_q("SELECT coalesce(word = expected, false) AS a_ok, coalesce(candidates[1] = expected, false) AS b_ok, count(*) AS n FROM predictions GROUP BY ALL"))
def g19_paired_outcomes(spark, d):
    p = Q.predictions(spark, d)
    return M.paired_outcomes(p, p.withColumn("word", F.get("candidates", F.lit(0))))


def _registry(spark, d):
    each = M.summarize(Q.predictions(spark, d), "creator")
    n = F.regexp_extract("creator", "([0-9]+)", 1).cast("int")
    bad = F.when(n % 5 == 0, F.coalesce("precision", F.lit(0.0)) + 0.5).otherwise(F.col("precision"))
    return each.select(F.col("creator").alias("id"), F.when(n % 7 == 0, "odd").otherwise("current").alias("status"), "scored", "attempted", "correct", bad.alias("precision"), "coverage", F.when(n % 3 == 0, None).otherwise("fp").alias("fingerprint"), (n % 2 == 0).alias("stale"),
        F.when(n % 4 == 0, " ").otherwise("report").alias("report"), F.concat(F.lit("sha256:"), F.sha2("creator", 256)).alias("report_fingerprint"), (n % 3 > 0).alias("complete"))


_REG = f"""e AS (SELECT *, {_RATES}, regexp_extract(creator, '([0-9]+)', 1)::INT AS k FROM (SELECT creator, {_FLAG} FROM predictions GROUP BY creator)),
  reg AS (SELECT creator AS id, CASE WHEN k % 7 = 0 THEN 'odd' ELSE 'current' END AS status, scored, attempted, correct, CASE WHEN k % 5 = 0 THEN coalesce(precision, 0) + 0.5 ELSE precision END AS precision, coverage, CASE WHEN k % 3 <> 0 THEN 'fp' END AS fingerprint, k % 2 = 0 AS stale, k % 4 > 0 AND k % 3 > 0 AS backed FROM e)"""


@R.add(_q("""SELECT id, 'status' AS violation FROM reg WHERE status <> 'current' UNION ALL SELECT id, 'precision' FROM reg WHERE precision IS NULL OR abs(precision - correct::DOUBLE / attempted) > 1e-9
    UNION ALL SELECT id, 'coverage' FROM reg WHERE coverage IS NULL UNION ALL SELECT id, 'stale' FROM reg WHERE fingerprint IS NULL AND NOT stale UNION ALL SELECT id, 'provenance' FROM reg WHERE NOT backed""", _REG))
def g20_validate_metrics(spark, d):
    return M.validate_metrics(_registry(spark, d))


@R.add(_q("""SELECT id, id || ' | ' || scored || ' | ' || format('{:.2f}', coverage * 100) || '% | ' || CASE WHEN stale THEN 'stale' ELSE 'current' END AS line FROM (SELECT id, scored, coverage, stale FROM reg WHERE status = 'current' UNION ALL SELECT id, 0, coverage, true FROM reg WHERE status <> 'current')""", _REG))
def g21_upsert_and_render(spark, d):
    reg = _registry(spark, d).withColumn("precision", F.lit(0.0))
    fresh = reg.where("status <> 'current'").withColumn("scored", F.lit(0).cast("bigint")).withColumn("stale", F.lit(True))
    return M.render_metrics(M.upsert_metric(reg, fresh)).select("id", F.replace("line", F.lit("| 0.00% | "), F.lit("| ")).alias("line"))


@R.add(_q("SELECT pair_class, count(*) AS slots, count(word)::DOUBLE / count(*) AS fill_rate FROM predictions GROUP BY pair_class"))
def g22_fill_rate(spark, d):
    return M.fill_rate(Q.predictions(spark, d), "pair_class")


@R.add(_q(f"""SELECT e.*, h.labels FROM (SELECT *, {_RATES} FROM (SELECT creator, count(DISTINCT track_id) AS tracks, {_FLAG} FROM predictions GROUP BY creator)) e
    JOIN (SELECT creator, list(x ORDER BY x) AS labels FROM (SELECT creator, expected || '=' || count(*) AS x FROM predictions GROUP BY creator, expected) GROUP BY creator) h USING (creator)"""))
def g23_creator_summary(spark, d):
    return M.creator_summary(Q.predictions(spark, d))


@R.add(_q("SELECT track_id, token_index, CASE WHEN creator <> 'src1' AND token_index % 5 > 0 THEN word END AS word, creator <> 'src1' AND token_index % 5 > 0 AS reused FROM predictions"))
def g24_reuse_predictions(spark, d):
    now = Q.predictions(spark, d).withColumn("fingerprint", F.col("creator")).withColumn("context", F.lit("same"))
    before = now.withColumn("fingerprint", F.when(F.col("creator") == "src1", "changed").otherwise(F.col("creator"))).withColumn("context", F.when(F.col("token_index") % 5 == 0, "other").otherwise("same"))
    return M.reuse_predictions(now.select("track_id", "token_index", "fingerprint", "context", "candidates"), before, ("context", "candidates"))


@R.add(_q("SELECT creator, count(*) FILTER (creator <> 'src1') AS reused, count(*) FILTER (creator = 'src1') AS computed FROM predictions GROUP BY creator"))
def g24_reuse_counts(spark, d):
    now = Q.predictions(spark, d).withColumn("fingerprint", F.col("creator"))
    before = now.withColumn("fingerprint", F.when(F.col("creator") == "src1", "changed").otherwise(F.col("creator")))
    kept = M.reuse_predictions(now.select("track_id", "token_index", "fingerprint"), before)
    return M.reuse_counts(kept.join(now.select("track_id", "token_index", "creator"), ["track_id", "token_index"]), "creator")


@R.add(B.sql("features", more=Q.RULES, body="SELECT tier, sha256(string_agg('rule:' || substr(sha256(rule_id || chr(0) || array_to_string(candidates, '|')), 1, 20), chr(10) ORDER BY ord)) AS fingerprint, count(*) AS rules FROM rules GROUP BY tier"))
def g25_rule_fingerprints(spark, d):
    return M.rule_fingerprints(Q.rules(spark, d))


# Scored candidates: the components of a vector are log scores of the words w0, w1, ..., two variants each.
_SC = "sc AS (SELECT vec_id AS slot_id, 'w' || (i // 2) AS word, i % 2 AS variant, i AS list_order, embedding[i + 1]::DOUBLE * 8 AS logp FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings))"
_COMB = "cb AS (SELECT slot_id, word, min(list_order) AS list_order, max(logp) + ln(sum(exp(logp - m))) AS logp FROM (SELECT *, max(logp) OVER (PARTITION BY slot_id, word) AS m FROM sc) GROUP BY slot_id, word)"


def _scores(spark, d):
    rows = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("slot_id"), F.posexplode("embedding").alias("i", "x"))
    return rows.select("slot_id", F.concat(F.lit("w"), (F.col("i") / 2).cast("int").cast("string")).alias("word"), F.col("i").alias("list_order"), (F.col("x").cast("double") * 8).alias("logp"))


@R.add(f"WITH {_SC}, {_COMB} SELECT slot_id, word, round(logp, 9) AS logp FROM cb")
def l1_combine_variants(spark, d):
    return L.combine_variants(_scores(spark, d)).select("slot_id", "word", F.round("logp", 9).alias("logp"))


@R.add(f"WITH {_SC}, {_COMB}, r AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY logp DESC, list_order) AS k FROM cb WHERE logp >= 1) SELECT slot_id, word FROM r WHERE k = 1")
def l2_choose_scored(spark, d):
    return L.choose_scored(L.combine_variants(_scores(spark, d)), least=1.0).select("slot_id", "word")


@R.add(f"""WITH {_SC}, {_COMB}, r AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY logp DESC, list_order) AS k FROM cb WHERE logp >= 1),
    t AS (SELECT slot_id, max(logp) FILTER (k = 1) AS a, max(logp) FILTER (k = 2) AS b FROM r GROUP BY slot_id) SELECT s.slot_id, a IS NULL OR coalesce(a - b <= 0.5, false) AS uncertain FROM (SELECT DISTINCT slot_id FROM sc) s LEFT JOIN t USING (slot_id)""")
def l3_uncertain(spark, d):
    return L.uncertain(L.combine_variants(_scores(spark, d)), least=1.0, margin=0.5)


@R.add(f"""WITH {_SC}, {_COMB}, f AS (SELECT a.slot_id, a.word, a.list_order, 0.7 * a.logp + 0.3 * coalesce(b.logp, -4) AS z FROM cb a LEFT JOIN cb b ON b.slot_id = a.slot_id + 1 AND b.word = a.word),
    p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY slot_id) AS p, row_number() OVER (PARTITION BY slot_id ORDER BY z DESC, list_order) AS k FROM f) SELECT slot_id, CASE WHEN p >= 0.3 THEN word END AS word, round(p, 9) AS p FROM p WHERE k = 1""")
def l4_fuse_scores(spark, d):
    own = L.combine_variants(_scores(spark, d))
    other = own.select((F.col("slot_id") - 1).alias("slot_id"), "word", "logp")
    return L.fuse_scores(own, other, (0.7, 0.3), fill=-4.0, threshold=0.3).select("slot_id", "word", F.round("p", 9).alias("p"))


@R.add(f"""WITH {_SC}, {_COMB}, ch AS (SELECT slot_id, word AS choice, logp - second <= 0.5 AS unsure FROM (SELECT *, row_number() OVER w AS k, lead(logp) OVER w AS second FROM cb WINDOW w AS (PARTITION BY slot_id ORDER BY logp DESC, list_order)) WHERE k = 1),
    f AS (SELECT a.slot_id, a.word, a.list_order, 0.7 * a.logp + 0.3 * coalesce(b.logp, -4) AS z FROM cb a LEFT JOIN cb b ON b.slot_id = a.slot_id + 1 AND b.word = a.word),
    p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY slot_id) AS p, row_number() OVER (PARTITION BY slot_id ORDER BY z DESC, list_order) AS k FROM f)
    SELECT p.slot_id, CASE WHEN p < 0.3 OR choice IS NOT NULL AND NOT unsure AND substr(choice, 2)::INT % 4 = substr(word, 2)::INT % 4 THEN choice ELSE word END AS word, round(p, 9) AS p FROM p LEFT JOIN ch ON ch.slot_id = p.slot_id + 1 WHERE k = 1""")
def l4_fuse_families(spark, d):
    own = L.combine_variants(_scores(spark, d))
    other = own.select((F.col("slot_id") - 1).alias("slot_id"), "word", "list_order", "logp")
    choice = L.choose_scored(other, least=-1e9).join(L.uncertain(other, least=-1e9, margin=0.5), "slot_id")
    families = own.select("word").distinct().withColumn("family", (F.substring("word", 2, 9).cast("int") % 4).cast("string"))
    return L.fuse_scores(own, other, (0.7, 0.3), fill=-4.0, threshold=0.3, chosen=choice, families=families).select("slot_id", "word", F.round("p", 9).alias("p"))


@R.add(_q("SELECT track_id, token_index, coalesce(word, candidates[1]) AS word, CASE WHEN word IS NOT NULL THEN 'rules' WHEN candidates[1] IS NOT NULL THEN 'scores' END AS source FROM predictions"))
def l5_arbitrate(spark, d):
    p = Q.predictions(spark, d)
    return L.arbitrate(p.select("track_id", "token_index", F.col("word").alias("rule_word")), p.select("track_id", "token_index", F.get("candidates", F.lit(0)).alias("score_word")), "rules-first")
