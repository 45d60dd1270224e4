"""Queries over pattern mining (H). Folds and halves hash the creator; the present prediction is ``that`` before ``the``."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotloom.functions import text as T
from slotloom.operators import mining as H
from slotloom.operators import slots as S
from slotloom.plans import base as B
from slotloom.plans.registry import Registry
from slotloom.sources.scratch import cut

R = Registry(share=True)
FOLDS = 3
_BASE = """mr AS MATERIALIZED (SELECT track_id || ':' || token_index AS row_id, track_id, token_index, creator, (('0x' || substr(sha256('name:' || creator), 1, 8))::BIGINT % 3)::INT AS fold, (('0x' || substr(sha256('h' || creator), 1, 2))::INT % 2)::INT AS half,
    CASE pair_class WHEN 'unknown' THEN 'discovery' ELSE 'manual' END AS tier, CASE WHEN token_index % 11 = 0 THEN NULL ELSE expected END AS expected,
    max(CASE WHEN off = 1 AND tok = 'the' THEN 'that' END) AS predicted, list(off || '=' || tok ORDER BY off) AS f FROM features GROUP BY ALL),
  k2 AS (SELECT row_id, creator, fold, half, tier, track_id, token_index, expected, predicted, unnest(list_concat(f, list_concat([f[1] || '&' || f[2], f[1] || '&' || f[3], f[1] || '&' || f[4], f[2] || '&' || f[3], f[2] || '&' || f[4], f[3] || '&' || f[4]],
    [f[1] || '&' || f[2] || '&' || f[3], f[2] || '&' || f[3] || '&' || f[4], array_to_string(f, '&')]))) AS leaf_key FROM mr),
  keyed AS MATERIALIZED (SELECT * FROM k2 WHERE leaf_key IN (SELECT leaf_key FROM k2 GROUP BY leaf_key HAVING count(*) >= 4))"""
_STATS = """(WITH c AS (SELECT {by} leaf_key, expected, count(*) AS n, count(*) FILTER (predicted IS NULL) AS open, count(*) FILTER (predicted = expected) AS r FROM {src} WHERE expected IS NOT NULL GROUP BY ALL),
  d AS (SELECT *, sum(n) OVER w AS support, sum(open) OVER w AS ms, sum(r) OVER w AS nr, row_number() OVER (PARTITION BY {by} leaf_key ORDER BY n DESC, expected) AS k FROM c WINDOW w AS (PARTITION BY {by} leaf_key)),
  p AS (SELECT {by} leaf_key, count(DISTINCT creator) AS creators FROM {src} WHERE expected IS NOT NULL GROUP BY ALL)
  SELECT {by} leaf_key, expected AS target, support::BIGINT AS support, n AS target_count, n::DOUBLE / support AS precision, ms::BIGINT AS marginal_support, open AS marginal_correct, CASE WHEN ms > 0 THEN open::DOUBLE / ms END AS marginal_precision, (n - nr)::BIGINT AS gain, creators
  FROM d JOIN p USING ({by} leaf_key) WHERE k = 1)"""
_GOOD = "support >= 4 AND creators >= 2 AND precision >= 0.92 AND marginal_support >= 3 AND marginal_precision >= 0.92 AND gain >= 1"
_UNITS = """un AS MATERIALIZED (SELECT leaf_key, creator, track_id AS context_id, token_index AS slot_index, CASE WHEN count(DISTINCT expected) = 1 AND count(*) = count(expected) THEN min(expected) END AS label, max(predicted) AS predicted FROM keyed GROUP BY leaf_key, creator, track_id, token_index)"""
_LEADS = _UNITS + """, lc AS (SELECT leaf_key, label, count(*) AS n, count(DISTINCT creator) AS cr, count(*) FILTER (predicted IS NULL) AS open, count(*) FILTER (predicted = label) AS r FROM un GROUP BY ALL),
  ld AS (SELECT *, sum(n) OVER (PARTITION BY leaf_key) AS units, row_number() OVER (PARTITION BY leaf_key ORDER BY label IS NULL, n DESC, label) AS k FROM lc),
  leads AS MATERIALIZED (SELECT *, list_filter([CASE WHEN target_count < 4 THEN 'support' END, CASE WHEN creators < 2 THEN 'creators' END, CASE WHEN precision < 0.92 THEN 'precision' END, CASE WHEN gain < 1 THEN 'gain' END], lambda x: x IS NOT NULL) AS reasons
    FROM (SELECT leaf_key, label AS target, units::BIGINT AS units, n AS target_count, n::DOUBLE / units AS precision, cr AS creators, open AS marginal_correct, n - r AS gain FROM ld WHERE k = 1 AND label IS NOT NULL))"""


def _rows(spark, d):
    rows = B.labelled(spark, d)
    ahead = F.get(F.filter("features", lambda f: f["off"] == 1), F.lit(0))["tok"]
    return rows.select(
        F.concat_ws(":", F.col("track_id").cast("string"), F.col("token_index").cast("string")).alias("row_id"), F.col("track_id").alias("context_id"), F.col("token_index").alias("slot_index"), "creator",
        T.hash_fold(F.concat(F.lit("name:"), "creator"), FOLDS).alias("fold"), T.half_fold("creator", "h").alias("half"), F.when(F.col("pair_class") == "unknown", "discovery").otherwise("manual").alias("tier"),
        F.when(F.col("token_index") % 11 != 0, F.col("expected")).alias("expected"), F.when(ahead == "the", "that").alias("predicted"), "features",
    )


def _keyed(spark, d):
    return H.prune_by_support(H.row_conditions(_rows(spark, d)))


def _units(spark, d):
    return H.support_units(_keyed(spark, d))


def _q(body: str, *more: str) -> str:
    return B.sql("features", more=", ".join([_BASE, *more]), body=body)


@R.add(B.sql("features", body="SELECT track_id, token_index, off::INT AS off, tok FROM features"))
def h1_features(spark, d):
    return B.labelled(spark, d).select("track_id", "token_index", F.explode("features").alias("f")).select("track_id", "token_index", "f.off", "f.tok")


@R.add(r"""WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]\n_][^\]\n]*)?\]', ' ', 'g'), '>{2,}', ' ', 'g'), '[♪♫]', ' ', 'g'), '</?[A-Za-z][^>\n]*>', ' ', 'g'), '(\[__\]|\S+)', 1) AS w
      FROM (SELECT page_id, regexp_replace(replace(html, chr(160), ' '), '(?i)\b(from|that|this|with)\b', '[__]', 'g') AS text FROM pages)),
    u AS (SELECT page_id, w, i, w[i] = '[__]' AS starts, sum(len(string_split(w[i], '[__]')) - 1) OVER (PARTITION BY page_id ORDER BY i) - 1 AS k FROM (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
    f AS (SELECT page_id, k, off, CASE WHEN i + off < 1 THEN '<BOS>' WHEN i + off > len(w) THEN '<EOS>' ELSE lower(w[i + off]) END AS tok FROM u, (VALUES (-4), (-3), (-2), (-1), (1), (2), (3), (4)) o(off) WHERE starts)
    SELECT page_id AS track_id, k::INT AS token_index, off, tok, CASE WHEN off < 0 THEN regexp_matches(tok, '[.!?]["''’”)}\]]*$') ELSE regexp_matches(tok, '^[.!?]') END AS boundary FROM f""")
def h2_discovery_features(spark, d):
    pages = B.table(spark, d, "pages").select(F.col("page_id").alias("track_id"), F.regexp_replace("html", r"(?i)\b(from|that|this|with)\b", "[__]").alias("text"))
    rows = S.discovery_features(pages, 4, 4)
    return rows.select("track_id", F.col("token_index").cast("int").alias("token_index"), F.explode("features").alias("f")).select("track_id", "token_index", "f.off", "f.tok", "f.boundary")


@R.add(_q("SELECT leaf_key, count(*) AS n FROM k2 GROUP BY leaf_key"))
def h3_conditions(spark, d):
    return H.row_conditions(_rows(spark, d)).groupBy("leaf_key").agg(F.count("*").alias("n"))


@R.add(_q("SELECT row_id, leaf_key FROM keyed"))
def h4_prune_by_support(spark, d):
    return _keyed(spark, d).select("row_id", "leaf_key")


@R.add(_q("SELECT * FROM " + _STATS.format(by="", src="keyed")))
def h5_leaf_stats(spark, d):
    return H.counted_stats(H.leaf_counts(_rows(spark, d)))


@R.add(_q("SELECT leaf_key, target, support, gain, len(string_split(leaf_key, '&'))::INT AS depth FROM " + _STATS.format(by="", src="keyed") + f" WHERE {_GOOD}"))
def h6_qualify_leaves(spark, d):
    return H.qualify_leaves(H.counted_stats(H.leaf_counts(_rows(spark, d)))).select("leaf_key", "target", "support", "gain", "depth")


@R.add(_q("SELECT leaf_key, creator, context_id, slot_index, label FROM un", _UNITS))
def h7_support_units(spark, d):
    return _units(spark, d).select("leaf_key", "creator", "context_id", "slot_index", "label")


@R.add(_q("SELECT * FROM leads", _LEADS))
def h8_discovery_leads(spark, d):
    return H.discovery_leads(_units(spark, d))


@R.add(_q("SELECT reason, n, samples FROM (SELECT reason, count(*) AS n, list(leaf_key ORDER BY k) FILTER (k <= 10) AS samples FROM (SELECT reason, leaf_key, row_number() OVER (PARTITION BY reason ORDER BY target_count DESC, leaf_key) AS k FROM (SELECT leaf_key, target_count, unnest(reasons) AS reason FROM leads)) GROUP BY reason)", _LEADS))
def h9_rejections(spark, d):
    return H.rejections(H.discovery_leads(_units(spark, d)))


@R.add(_q("""SELECT m.leaf_key, m.target, o.target AS other_target, o.units AS other_units, coalesce(o.target <> m.target AND o.units >= 4 AND o.precision >= 0.92, false) AS veto
    FROM (FROM ldt WHERE tier = 'manual') m LEFT JOIN (FROM ldt WHERE tier = 'discovery') o USING (leaf_key)""",
    """unt AS (SELECT tier, leaf_key, CASE WHEN count(DISTINCT expected) = 1 AND count(*) = count(expected) THEN min(expected) END AS label FROM keyed GROUP BY tier, leaf_key, creator, track_id, token_index),
    lct AS (SELECT tier, leaf_key, label, count(*) AS n FROM unt GROUP BY ALL), ldt AS MATERIALIZED (SELECT tier, leaf_key, label AS target, units, n::DOUBLE / units AS precision FROM
      (SELECT *, sum(n) OVER (PARTITION BY tier, leaf_key)::BIGINT AS units, row_number() OVER (PARTITION BY tier, leaf_key ORDER BY label IS NULL, n DESC, label) AS k FROM lct) WHERE k = 1 AND label IS NOT NULL)"""))
def h10_cross_tier_audit(spark, d):
    units = H.support_units(_keyed(spark, d), "tier")
    leads = H.discovery_leads(units, "tier")
    own, other = leads.where("tier = 'manual'").drop("tier"), leads.where("tier = 'discovery'").drop("tier")
    return H.cross_tier_audit(own, other).select("leaf_key", "target", "other_target", "other_units", "veto")


@R.add(_q("""SELECT label, sum(n)::BIGINT AS clean, sum(u)::BIGINT AS unknown, sum(a - n - u)::BIGINT AS competing, max(creators) AS creators FROM (SELECT label, leaf_key, count(*) AS n FROM un WHERE label IS NOT NULL GROUP BY ALL)
    JOIN (SELECT leaf_key, count(*) AS a, count(*) FILTER (label IS NULL) AS u FROM un GROUP BY leaf_key) USING (leaf_key) JOIN (SELECT label, count(DISTINCT creator) AS creators FROM un WHERE label IS NOT NULL GROUP BY label) USING (label) GROUP BY label""", _UNITS))
def h11_word_summary(spark, d):
    return H.word_summary(_units(spark, d))


_APPLY = "lv AS MATERIALIZED (SELECT *, len(string_split(leaf_key, '&')) AS depth FROM " + _STATS.format(by="", src="keyed") + f" WHERE {_GOOD})"


@R.add(_q("""SELECT *, correct::DOUBLE / attempted AS precision, correct::DOUBLE / slots AS coverage FROM (SELECT count(*) AS slots, count(*) FILTER (o IS NOT NULL AND o IS DISTINCT FROM predicted) AS changed, count(coalesce(o, predicted)) AS attempted, count(*) FILTER (coalesce(o, predicted) = expected) AS correct, count(*) FILTER (predicted = expected) AS baseline_correct
    FROM mr LEFT JOIN (SELECT row_id, target AS o FROM (SELECT row_id, target, row_number() OVER (PARTITION BY row_id ORDER BY depth, gain DESC, precision DESC, support DESC, leaf_key) AS k FROM keyed JOIN lv USING (leaf_key)) WHERE k = 1) USING (row_id))""", _APPLY))
def h12_apply_leaves(spark, d):
    rows = _rows(spark, d)
    leaves = H.qualify_leaves(H.counted_stats(H.leaf_counts(rows)))
    return H.model_metrics(H.with_overrides(rows, H.apply_leaves(H.row_conditions(rows.select("row_id", "features")), leaves)))


_CV = "tr AS (SELECT keyed.*, held::INT AS held FROM keyed, (SELECT unnest(range(0, 3)) AS held) WHERE fold <> held), cvl AS MATERIALIZED (SELECT *, len(string_split(leaf_key, '&')) AS depth FROM " + _STATS.format(by="held,", src="tr") + f" WHERE {_GOOD})"


@R.add(_q("""SELECT *, CASE WHEN attempted > 0 THEN correct::DOUBLE / attempted END AS precision, correct::DOUBLE / slots AS coverage FROM (SELECT fold AS held, count(*) AS slots, count(*) FILTER (o IS NOT NULL AND o IS DISTINCT FROM predicted) AS changed, count(coalesce(o, predicted)) AS attempted, count(*) FILTER (coalesce(o, predicted) = expected) AS correct, count(*) FILTER (predicted = expected) AS baseline_correct
    FROM mr LEFT JOIN (SELECT row_id, target AS o FROM (SELECT row_id, target, row_number() OVER (PARTITION BY row_id ORDER BY depth, gain DESC, precision DESC, support DESC, leaf_key) AS k FROM keyed JOIN cvl ON keyed.leaf_key = cvl.leaf_key AND keyed.fold = cvl.held) WHERE k = 1) USING (row_id) GROUP BY fold)""".replace("support DESC, leaf_key)", "support DESC, keyed.leaf_key)"), _CV))
def h13_creator_fold_cv(spark, d):
    return H.creator_fold_cv(_rows(spark, d), FOLDS)


@R.add(_q("""SELECT leaf_key, target, support, correct, correct::DOUBLE / support AS precision FROM (SELECT leaf_key, target, count(*) AS support, count(*) FILTER (expected = target) AS correct FROM keyed JOIN (SELECT leaf_key, target FROM cvl GROUP BY ALL HAVING count(*) = 3) USING (leaf_key) GROUP BY ALL)
    WHERE correct::DOUBLE / support >= 0.8 ORDER BY correct DESC, precision DESC, leaf_key LIMIT 100""", _CV))
def h14_proposals(spark, d):
    return H.proposals(_rows(spark, d), FOLDS, least=0.8)


@R.add("SELECT doc_id, quality IS NOT NULL AND toxic = 0 AS eligible FROM documents LEFT JOIN labels USING (doc_id)")
def h14b_promotion_eligible(spark, d):
    rows = B.table(spark, d, "documents").select("doc_id").join(B.table(spark, d, "labels"), "doc_id", "left")
    return H.promotion_eligible(rows.select("doc_id", F.col("quality").isNull().alias("discovery_only"), (F.col("toxic") == 0).alias("context_faithful"), F.lit("current").alias("policy"))).select("doc_id", "eligible")


_TRANSFER = """c AS (SELECT leaf_key, target, expected, count(*) AS n FROM keyed JOIN (SELECT leaf_key, target FROM lv) USING (leaf_key) WHERE tier = 'discovery' AND expected IS NOT NULL GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER w AS support, sum(CASE WHEN expected = target THEN n ELSE 0 END) OVER w AS hit, row_number() OVER (PARTITION BY leaf_key ORDER BY n DESC, expected) AS k FROM c WINDOW w AS (PARTITION BY leaf_key))"""


@R.add(_q("SELECT leaf_key, target, support::BIGINT AS support, hit::DOUBLE / support AS precision, expected AS dominant, expected <> target AND support >= 4 AND n::DOUBLE / support >= 0.92 AS reversed FROM t WHERE k = 1", _APPLY, _TRANSFER))
def h15_transfer_audit(spark, d):
    keyed = _keyed(spark, d)
    return H.transfer_audit(H.qualify_leaves(H.leaf_stats(keyed)), keyed.where("tier = 'discovery'"))


@R.add(_q(r"SELECT DISTINCT leaf_key, CASE WHEN regexp_matches(leaf_key, '^-1=[\p{L}\p{N}_'']+$') THEN regexp_replace(leaf_key, '^-1=', '') || ' [_]' WHEN regexp_matches(leaf_key, '^-2=[\p{L}\p{N}_'']+$') THEN regexp_replace(leaf_key, '^-2=', '') || ' * [_]' WHEN regexp_matches(leaf_key, '^1=[\p{L}\p{N}_'']+$') THEN '[_] ' || regexp_replace(leaf_key, '^1=', '') WHEN regexp_matches(leaf_key, '^2=[\p{L}\p{N}_'']+$') THEN '[_] * ' || regexp_replace(leaf_key, '^2=', '') END AS pattern FROM keyed WHERE NOT contains(leaf_key, '&')"))
def h16_render_pattern(spark, d):
    return _keyed(spark, d).where(~F.col("leaf_key").contains("&")).select("leaf_key").distinct().select("leaf_key", H.render_pattern("leaf_key").alias("pattern"))


@R.add(_q("SELECT tier, count(*) FILTER (expected = 'that') AS positive, count(*) FILTER (expected <> 'that') AS counter, count(*) FILTER (expected IS NULL) AS unknown FROM keyed WHERE leaf_key = '1=the' GROUP BY tier"))
def h17_preview_pattern(spark, d):
    return H.preview_pattern(_keyed(spark, d), "1=the", "that")


CLASSES = {"the": "article", "a": "article", "and": "link", "or": "link", "of": "place", "to": "place", "in": "place", "on": "place", "is": "verb", "was": "verb", "are": "verb", "be": "verb"}
_CLS = "cls(tok, cls) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CLASSES.items()) + ")"
_TAG = _CLS + ", tg AS MATERIALIZED (SELECT mr.row_id, mr.half, mr.tier, mr.expected, mr.creator, f.off, f.tok, cls FROM mr JOIN features f ON mr.track_id = f.track_id AND mr.token_index = f.token_index LEFT JOIN cls ON f.tok = cls.tok)"
_PATS = _TAG + """, sd AS (SELECT row_id, off, list_distinct(list_filter([tok, '<' || cls || '>'], lambda x: x IS NOT NULL)) AS x FROM tg WHERE tok NOT IN ('<BOS>', '<EOS>')),
  op AS (SELECT row_id, coalesce(any_value(x) FILTER (off = -2), []::VARCHAR[]) AS a, coalesce(any_value(x) FILTER (off = -1), []::VARCHAR[]) AS b, coalesce(any_value(x) FILTER (off = 1), []::VARCHAR[]) AS c, coalesce(any_value(x) FILTER (off = 2), []::VARCHAR[]) AS d FROM sd GROUP BY row_id),
  lr AS (SELECT row_id, unnest(list_concat([''], b, flatten(list_transform(a, lambda x: list_transform(b, lambda y: x || ' ' || y))))) AS l, list_concat([''], c, flatten(list_transform(c, lambda x: list_transform(d, lambda y: x || ' ' || y)))) AS rs FROM op),
  pt AS MATERIALIZED (SELECT row_id, trim(l || ' [] ' || r, ' ') AS pattern, mr.half, mr.tier, mr.expected, mr.creator FROM (SELECT row_id, l, unnest(rs) AS r FROM lr) JOIN mr USING (row_id) WHERE l <> '' OR r <> '')"""
_CHOICE = _PATS + """, wc AS (SELECT pattern, half, tier, expected, count(*) AS n, count(DISTINCT creator) AS creators FROM pt WHERE expected IS NOT NULL GROUP BY ALL),
  wo AS (SELECT *, sum(n) OVER w AS total, row_number() OVER (PARTITION BY pattern, half, tier ORDER BY n DESC, expected) AS k, coalesce(sum(n) FILTER (tier <> 'manual') OVER (PARTITION BY pattern, half), 0) AS other, coalesce(sum(n) FILTER (tier <> 'manual') OVER (PARTITION BY pattern, half, expected), 0) AS other_n FROM wc WINDOW w AS (PARTITION BY pattern, half, tier)),
  ch AS MATERIALIZED (SELECT pattern, half, tier, expected AS word, n, total, creators, total >= 5 AND n::DOUBLE / total >= 0.5 AND creators >= 2 AND (tier <> 'manual' OR (q + 3.8416 / (2 * total) - 1.96 * sqrt((q * (1 - q) + 3.8416 / (4 * total)) / total)) / (1 + 3.8416 / total) >= 0.2 AND (other < 5 OR other_n::DOUBLE / other >= 0.5)) AS passes FROM (SELECT *, n::DOUBLE / total AS q FROM wo) WHERE k = 1)"""


def _classes(spark):
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("tok"), F.lit(v).alias("cls")) for k, v in CLASSES.items()])).alias("c")).select("c.*")


def _tagged(spark, d):
    rows = _rows(spark, d)
    tokens = rows.select("row_id", "half", "tier", "expected", "creator", F.explode("features").alias("f")).select("row_id", "half", "tier", "expected", "creator", "f.off", "f.tok")
    return H.class_tag(tokens, F.broadcast(_classes(spark)))


def _patterns(spark, d):
    return H.class_patterns(_tagged(spark, d)).join(_rows(spark, d).drop("features"), "row_id")


@R.add(_q("SELECT coalesce(cls, 'none') AS cls, count(*) AS n FROM tg GROUP BY 1", _TAG))
def h18_class_tag(spark, d):
    return _tagged(spark, d).groupBy(F.coalesce("cls", F.lit("none")).alias("cls")).agg(F.count("*").alias("n"))


@R.add(_q("SELECT pattern, count(*) AS n FROM pt GROUP BY pattern", _PATS))
def h19_class_patterns(spark, d):
    return H.class_patterns(_tagged(spark, d)).groupBy("pattern").agg(F.count("*").alias("n"))


@R.add(_q("SELECT tok, cls, count(*) AS n, count(*) AS total FROM tg WHERE cls IS NOT NULL GROUP BY ALL HAVING count(*) >= 3", _TAG))
def h20_induce_classes(spark, d):
    return H.induce_classes(_tagged(spark, d))


@R.add(_q("SELECT pattern, half, tier, word, n, total::BIGINT AS total, creators, passes FROM ch", _CHOICE))
def h21_word_choice(spark, d):
    return H.word_choice(_patterns(spark, d), share=0.5, lower=0.2)


@R.add(_q("SELECT pattern, tier, min(word) AS word, sum(n)::BIGINT AS n FROM ch WHERE passes GROUP BY ALL HAVING count(DISTINCT half) = 2 AND count(DISTINCT word) = 1", _CHOICE))
def h21_two_fold_gate(spark, d):
    return H.two_fold_gate(H.word_choice(_patterns(spark, d), share=0.5, lower=0.2))


#: The driver's hidden words are nearly random: lower bars than the operator's own.
GATE = H.Gate(share=0.5, lower=0.2)


def _written_patterns(spark, d):
    return cut(_patterns(spark, d), "patterns")


_SCOPED = _PATS + """, sc AS (SELECT pattern, unnest([-1, half]) AS scope, tier, expected, creator, predicted IS NULL AS open FROM pt JOIN (SELECT row_id, predicted FROM mr) USING (row_id) WHERE expected IS NOT NULL),
  cn AS MATERIALIZED (SELECT pattern, scope, tier, expected, count(*) AS n, count(DISTINCT creator) AS creators, count(*) FILTER (open) AS o, count(DISTINCT creator) FILTER (open) AS oc FROM sc GROUP BY ALL),
  cw AS (SELECT *, sum(n) OVER (PARTITION BY pattern, scope, tier) AS total, row_number() OVER (PARTITION BY pattern, scope, tier ORDER BY n DESC, expected) AS k, coalesce(sum(n) FILTER (tier = 'discovery') OVER (PARTITION BY pattern, scope), 0) AS other, coalesce(sum(n) FILTER (tier = 'discovery') OVER (PARTITION BY pattern, scope, expected), 0) AS other_n FROM cn),
  chs AS (SELECT pattern, scope, arg_min({'word': expected, 'tier': tier}, CASE tier WHEN 'discovery' THEN 1 ELSE 2 END) AS c FROM (SELECT *, n::DOUBLE / total AS q FROM cw WHERE k = 1)
    WHERE total >= 5 AND q >= 0.5 AND creators >= 2 AND (tier <> 'manual' OR (q + 3.8416 / (2 * total) - 1.96 * sqrt((q * (1 - q) + 3.8416 / (4 * total)) / total)) / (1 + 3.8416 / total) >= 0.2 AND (other < 5 OR other_n::DOUBLE / other >= 0.5)) GROUP BY ALL),
  ag AS (SELECT pattern, min(c.word) AS word, min(c.tier) AS own FROM chs GROUP BY pattern HAVING count(*) = 3 AND min(c.word) = max(c.word) AND min(c.tier) = max(c.tier)),
  lf AS (SELECT pattern, scope, word, own, sum(o) FILTER (tier = own) AS n, coalesce(sum(o) FILTER (tier = own AND expected = word), 0) AS r, coalesce(sum(oc) FILTER (tier = own AND expected = word), 0) AS people, coalesce(sum(o) FILTER (tier = 'discovery'), 0) AS other, coalesce(sum(o) FILTER (tier = 'discovery' AND expected = word), 0) AS other_n FROM cn JOIN ag USING (pattern) GROUP BY ALL)"""


@R.add(_q("""SELECT pattern, word, own AS tier FROM (SELECT *, r::DOUBLE / n AS q FROM lf WHERE n >= 5) WHERE q >= 0.5 AND people >= 2 AND (own <> 'manual' OR (q + 3.8416 / (2 * n) - 1.96 * sqrt((q * (1 - q) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n) >= 0.2 AND (other < 5 OR other_n::DOUBLE / other >= 0.5))
    GROUP BY ALL HAVING count(*) = 3""", _SCOPED))
def h21_creator_gate(spark, d):
    return H.creator_gate(_patterns(spark, d), GATE)


@R.add()
def h22_greedy_select(spark, d):
    return H.greedy_select(H.gated_hits(_written_patterns(spark, d), GATE), gate=GATE)


@R.add(_q(r"SELECT DISTINCT replace(pattern, '[]', '[' || word || ']') AS template, word FROM ch WHERE passes AND regexp_matches(pattern, '^(\[\]|<[a-z]+>|[\p{L}\p{N}_'']+)( (\[\]|<[a-z]+>|[\p{L}\p{N}_'']+))*$') AND pattern NOT LIKE '<article>%'", _CHOICE))
def h23_emit_templates(spark, d):
    good = H.word_choice(_patterns(spark, d), share=0.5, lower=0.2).where("passes")
    existing = good.where("pattern LIKE '<article>%'").select(F.replace("pattern", F.lit("[]"), F.concat(F.lit("["), "word", F.lit("]"))).alias("template"))
    return H.emit_templates(good, existing)


@R.add()
def h24_train_only_check(spark, d):
    return H.train_only_check(_tagged(spark, d), _rows(spark, d).select("row_id", "half", "tier", "expected", "creator"), both_sides=False, lower=0.8)
