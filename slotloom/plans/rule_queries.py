"""Queries over the rule operators (D). The rules are read off the labelled slots themselves: one rule for each word
seen often enough just before or after a slot, its candidates in order of frequency."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotloom.operators import rules as U
from slotloom.operators import slots as S
from slotloom.operators.sampling import numbered
from slotloom.plans import base as B
from slotloom.plans.registry import Registry
from slotloom.sources.scratch import cut

R = Registry(share=True)
SUPPORT = 5

FC = "fc AS MATERIALIZED (SELECT off, tok, expected, count(*) AS n FROM features WHERE off IN (-1, 1) AND tok <> '[__]' GROUP BY ALL)"
RULES = FC + f""", rules AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY rule_id))::BIGINT AS ord, CASE WHEN len(candidates) = 1 THEN 'exact' ELSE 'productive' END AS tier
    FROM (SELECT off || ':' || tok AS rule_id, off, tok, list(expected ORDER BY n DESC, expected) AS candidates, sum(n)::BIGINT AS support FROM fc GROUP BY off, tok HAVING sum(n) >= {SUPPORT}))"""
# Slots right beside another slot, which rules of one blank leave alone.
TOUCH = RULES + ", touch AS MATERIALIZED (SELECT DISTINCT track_id, token_index FROM features WHERE off IN (-1, 1) AND tok = '[__]')"
# No rule reaches over the end of a sentence at a slot, unless an exact one spans it.
FREE = "SELECT * EXCLUDE (spanned) FROM (SELECT *, bool_or(tier = 'exact' AND off > 0) OVER (PARTITION BY track_id, token_index) AS spanned FROM found) WHERE NOT breaks OR off < 0 OR spanned"
MATCHES = TOUCH + f""", found AS (SELECT track_id, creator, pair_class, token_index, expected, breaks, off, rule_id, candidates, ord, tier FROM (FROM features WHERE joined) JOIN rules USING (off, tok) ANTI JOIN touch USING (track_id, token_index)),
    matches AS MATERIALIZED (SELECT track_id, creator, pair_class, token_index, expected, rule_id, candidates, ord, tier FROM ({FREE}))"""
PRIORS = MATCHES + """, pc AS (SELECT rule_id, expected, count(*) AS n FROM matches GROUP BY ALL),
    pr AS (SELECT *, sum(n) OVER (PARTITION BY rule_id) AS support, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS second FROM pc WINDOW w AS (PARTITION BY rule_id ORDER BY n DESC, expected)),
    priors AS (SELECT rule_id, expected AS word, n::DOUBLE / support AS p, (n - second)::DOUBLE / support AS margin, support::BIGINT AS support FROM pr WHERE k = 1)"""
DECIDED = PRIORS + """, win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, token_index ORDER BY ord) AS k FROM matches) WHERE k = 1),
    decided AS MATERIALIZED (SELECT track_id, creator, pair_class, token_index, expected, rule_id, candidates, CASE WHEN len(candidates) = 1 THEN candidates[1] ELSE word END AS word FROM win JOIN priors USING (rule_id)),
    predictions AS MATERIALIZED (SELECT l.track_id, l.creator, l.pair_class, l.token_index, l.expected, d.rule_id, d.candidates, d.word FROM labelled l LEFT JOIN decided d USING (track_id, token_index))"""


def rules(spark, d):
    flat = features(spark, d).where(F.col("off").isin(-1, 1) & (F.col("tok") != "[__]"))
    counts = flat.groupBy("off", "tok", "expected").agg(F.count("*").alias("n"))
    grouped = counts.groupBy("off", "tok").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "expected"))).alias("c"), F.sum("n").alias("support")).where(F.col("support") >= SUPPORT)
    named = grouped.select(F.concat_ws(":", F.col("off").cast("string"), "tok").alias("rule_id"), "off", "tok", F.transform("c", lambda x: x["expected"]).alias("candidates"), "support")
    ranked = numbered(cut(named, "rules"), "rule_id", name="ord").withColumn("ord", F.col("ord") + 1)
    tier = F.when(F.size("candidates") == 1, "exact").otherwise("productive")
    return ranked.select("rule_id", tier.alias("tier"), "ord", "candidates", "support", F.array(F.struct("off", "tok")).alias("conditions"), F.col("off").alias("anchor_off"), F.col("tok").alias("anchor_tok"))


def features(spark, d):
    rows = B.labelled(spark, d)
    return rows.select("track_id", "creator", "pair_class", "token_index", "expected", F.explode("features").alias("f")).select("track_id", "creator", "pair_class", "token_index", "expected", "f.off", "f.tok")


def matches(spark, d):
    rows = B.labelled(spark, d)
    found = U.candidate_matches(rows, rules(spark, d).drop("support"))
    return found.join(rows.select("track_id", "token_index", "creator", "pair_class", "expected"), ["track_id", "token_index"])


def decided(spark, d):
    found = matches(spark, d)
    return U.decide(U.resolve_single(found), U.estimate_priors(found))


def predictions(spark, d):
    """Every labelled slot with its decision, if there is one."""
    rows = B.labelled(spark, d).select("track_id", "creator", "pair_class", "token_index", "expected")
    return rows.join(decided(spark, d).select("track_id", "token_index", "rule_id", "candidates", "word"), ["track_id", "token_index"], "left")


def _q(more: str, body: str) -> str:
    return B.sql("features", more=more, body=body)


@R.add("""SELECT l.g AS group_no, l.g AS pattern_no, a || ' ' || b || ' ' || c AS template, l.g * 1000000000::BIGINT + l.g * 1000000 + (i - 1) * 6 + (j - 1) * 3 + (k - 1) AS ord
    FROM (SELECT r_regionkey::BIGINT AS g FROM region) l, (VALUES (1, 'go'), (2, 'come')) x(i, a), (VALUES (1, 'on'), (2, 'off')) y(j, b), (VALUES (1, 'now'), (2, 'then'), (3, 'soon')) z(k, c)""")
def d1_expand_rules(spark, d):
    parts = F.array(*[F.array(*map(F.lit, p)) for p in (["go", "come"], ["on", "off"], ["now", "then", "soon"])])
    patterns = B.table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("group_no"), F.col("r_regionkey").cast("bigint").alias("pattern_no"), parts.alias("parts"))
    return U.expand_rules(patterns)


@R.add("SELECT n_name AS template, ['a', 'b c']::VARCHAR[] AS candidates, 2 AS blanks, [lower(n_name), '<EOS>'] AS toks, [-2]::INT[] AS kept FROM nation WHERE NOT contains(n_name, ' ')".replace("n_name AS template", "n_name || ' [__] * [a|b c] $' AS template").replace("[lower(n_name), '<EOS>'] AS toks", "[lower(n_name), '[__]', '<EOS>'] AS toks"))
def d2_compile_rules(spark, d):
    templates = B.table(spark, d, "nation").where(~F.col("n_name").contains(" ")).select(F.concat("n_name", F.lit(" [__] * [a|b c] $")).alias("template"))
    return U.compile_rules(templates).select("template", "candidates", F.col("blanks"), F.transform("conditions", lambda c: c["tok"]).alias("toks"), "kept")


@R.add("SELECT 'frame:' || a.n_regionkey || ':' || lower(a.n_name) || ':' || lower(b.n_name) AS rule_id FROM nation a JOIN nation b USING (n_regionkey)")
def d3_frame_rules(spark, d):
    words = B.table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("set_id"), F.lower("n_name").alias("word"))
    return U.frame_rules(words, words, F.array(F.lit("this"), F.lit("that"))).select("rule_id")


@R.add(_q(RULES, "SELECT * FROM (SELECT rule_id, list_filter(candidates, lambda c: c IN ('this', 'that')) AS candidates FROM rules) WHERE len(candidates) > 0"))
def d4_restrict_candidates(spark, d):
    emitted = B.lexicon(spark).where(F.col("word").isin("this", "that"))
    return U.restrict_candidates(rules(spark, d), emitted).select("rule_id", "candidates")


@R.add(_q(MATCHES, "SELECT track_id, token_index, rule_id FROM matches"))
def d5_candidate_matches(spark, d):
    return matches(spark, d).select("track_id", "token_index", "rule_id")


CLASSES = {"the": "article", "a": "article", "and": "link", "or": "link", "of": "place", "to": "place", "in": "place", "on": "place", "is": "verb", "was": "verb", "are": "verb", "be": "verb"}
_CLS = "cls(tok, cls) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CLASSES.items()) + ")"
_SIDES = "SELECT track_id, token_index, off, tok FROM (FROM features ANTI JOIN touch USING (track_id, token_index)) WHERE joined AND NOT breaks"


@R.add(_q(TOUCH + ", " + _CLS + f", sd AS MATERIALIZED ({_SIDES})", r"""SELECT track_id, token_index, '<' || l.cls || '> [this|that] ' || g.tok AS rule_id FROM sd f JOIN cls l ON f.tok = l.tok JOIN sd g USING (track_id, token_index) JOIN rules r ON r.off = 1 AND r.tok = g.tok
    WHERE f.off = -1 AND g.off = 1 AND regexp_full_match(g.tok, '[\p{L}\p{N}_'']+')
    UNION ALL SELECT track_id, token_index, '<' || l.cls || '> [this|that] <' || h.cls || '>' FROM sd f JOIN cls l ON f.tok = l.tok JOIN sd g USING (track_id, token_index) JOIN cls h ON g.tok = h.tok WHERE f.off = -1 AND g.off = 1"""))
def d5_class_templates(spark, d):
    """Templates of a class before the slot and, after it, a frequent word or a class, all in one call."""
    words = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("tok"), F.lit(v).alias("cls")) for k, v in CLASSES.items()])).alias("c")).select("c.*")
    names = F.explode(F.array(*[F.lit(f"<{c}>") for c in sorted(set(CLASSES.values()))]))
    after = rules(spark, d).where(F.col("anchor_off") == 1).where(F.col("anchor_tok").rlike(r"^[\p{L}\p{N}_']+$")).select(F.col("anchor_tok").alias("after")).union(spark.range(1).select(names))
    templates = after.select(names.alias("before"), "after").select(F.concat_ws(" [this|that] ", "before", "after").alias("template"))
    table = U.compile_rules(templates).withColumn("rule_id", F.col("template"))
    counts = features(spark, d).groupBy("off", "tok").agg(F.count("*").alias("n"))
    return U.candidate_matches(B.labelled(spark, d), U.with_anchor(table, counts, words), words).select("track_id", "token_index", "rule_id")


@R.add(_q(TOUCH + """, found AS (SELECT f.track_id, f.token_index, f.breaks, f.off, r.tier, r.rule_id || '&' || g.tok AS rule_id FROM (FROM features ANTI JOIN touch USING (track_id, token_index)) f JOIN rules r USING (off, tok)
    JOIN features g ON f.track_id = g.track_id AND f.token_index = g.token_index AND g.off = 2 WHERE r.off = 1 AND g.tok = '<EOS>' AND f.joined AND g.joined)""", f"SELECT track_id, token_index, rule_id FROM ({FREE})"))
def d6_verify_match(spark, d):
    end = F.struct(F.lit(2).alias("off"), F.lit("<EOS>").alias("tok"))
    two = rules(spark, d).where("anchor_off = 1").withColumn("conditions", F.concat("conditions", F.array(end))).withColumn("rule_id", F.concat("rule_id", F.lit("&<EOS>")))
    return U.candidate_matches(B.labelled(spark, d), two).select("track_id", "token_index", "rule_id")


@R.add(_q(MATCHES, "SELECT m.track_id, m.token_index, m.rule_id FROM matches m JOIN features f USING (track_id, token_index) WHERE f.off = 2 AND f.tok IN ('the', 'and', 'of')"))
def d7_class_filter(spark, d):
    classes = spark.range(1).select(F.lit("function").alias("class_name"), F.explode(F.array(*map(F.lit, ["the", "and", "of"]))).alias("tok"))
    held = matches(spark, d).withColumn("class_off", F.lit(2)).withColumn("class_name", F.lit("function"))
    return U.class_filter(held, features(spark, d).select("track_id", "token_index", "off", "tok"), classes).select("track_id", "token_index", "rule_id")


@R.add(_q(RULES, "SELECT rule_id, (row_number() OVER (ORDER BY tier, ord))::INT AS place FROM rules"))
def d8_rule_order(spark, d):
    return U.rule_order(rules(spark, d).withColumn("priority", F.lit(0))).select("rule_id", "place")


@R.add(_q(DECIDED, "SELECT track_id, token_index, rule_id FROM win"))
def d9_resolve_single(spark, d):
    return U.resolve_single(matches(spark, d)).select("track_id", "token_index", "rule_id")


@R.add(_q(MATCHES + """, sp AS (SELECT track_id, token_index, (1 + ord % 2)::INT AS span, rule_id, ord FROM matches), sr AS (SELECT *, max(token_index + span) OVER (PARTITION BY track_id ORDER BY token_index, span, ord, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
    sc AS (SELECT *, sum(CASE WHEN reach IS NULL OR token_index >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY token_index, span, ord, rule_id ROWS UNBOUNDED PRECEDING) AS c FROM sr),
    sg AS (SELECT track_id, list([{'o': ord, 'r': rule_id, 't': token_index, 's': span}] ORDER BY ord, rule_id, token_index) AS m FROM sc GROUP BY track_id, c),
    sw AS (SELECT track_id, unnest(list_reduce(m, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.t < x[1].t + x[1].s AND x[1].t < y.t + y.s)) > 0 THEN a ELSE list_concat(a, x) END)) AS w FROM sg)""", "SELECT track_id, w.t AS token_index, w.s AS span, w.r AS rule_id, w.o AS ord FROM sw"))
def d9_resolve_overlaps(spark, d):
    spans = matches(spark, d).select("track_id", "token_index", (1 + F.col("ord") % 2).cast("int").alias("span"), "rule_id", "ord")
    return U.resolve_overlaps(spans)


@R.add(B.sql("labelled", body="SELECT track_id, token_index, coalesce(spot - lag(spot) OVER w = 1 OR lead(spot) OVER w - spot = 1, false) AS adjacent FROM labelled WINDOW w AS (PARTITION BY track_id ORDER BY spot)"))
def d10_adjacent_guard(spark, d):
    return U.adjacent_slots(B.labelled(spark, d)).select("track_id", "token_index", "adjacent")


@R.add(_q(DECIDED, "SELECT track_id, token_index, word FROM decided"))
def d11_decide(spark, d):
    return decided(spark, d).select("track_id", "token_index", "word")


@R.add(_q(DECIDED, "SELECT track_id, (token_index + k)::INT AS token_index, w AS word, list_sort(list_distinct(list_append(list_transform(candidates, lambda c, i: CASE WHEN i % 2 = 0 THEN c WHEN k = 0 THEN c ELSE 'more' END), w))) AS pieces FROM (SELECT track_id, token_index, candidates, unnest(range(0, 2)) AS k, unnest([word, 'more']) AS w FROM decided WHERE word IS NOT NULL)"))
def d12_explode_spans(spark, d):
    longer = F.transform("candidates", lambda c, i: F.when(i % 2 == 0, F.concat(c, F.lit(" more"))).otherwise(c))
    fills = decided(spark, d).where("word IS NOT NULL").withColumn("word", F.concat("word", F.lit(" more"))).withColumn("candidates", longer)
    return U.explode_spans(fills).select("track_id", "token_index", "word", F.array_sort("pieces").alias("pieces"))


@R.add(_q(DECIDED, """SELECT l.track_id, l.token_index, rule_id, CASE WHEN rule_id IS NULL THEN 'none' WHEN k > 1 THEN 'blocked' WHEN len(candidates) > 1 AND p < 0.5 THEN 'abstain' ELSE 'winner' END AS status, CASE WHEN k > 1 THEN first END AS blocked_by
    FROM labelled l LEFT JOIN (SELECT *, row_number() OVER w AS k, first_value(rule_id) OVER w AS first FROM matches JOIN priors USING (rule_id) WINDOW w AS (PARTITION BY track_id, token_index ORDER BY ord)) USING (track_id, token_index)"""))
def d13_trace(spark, d):
    found = matches(spark, d)
    return U.trace(B.labelled(spark, d), U.decide(found, U.estimate_priors(found), least=0.5))


@R.add(B.sql("masked", body="SELECT track_id, md5(p[1] || array_to_string(list_transform(range(1, len(p)), lambda i: CASE (i - 1) % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'x' ELSE '[__]' END || p[i + 1]), '')) AS digest FROM (SELECT track_id, string_split(text, '[__]') AS p FROM masked)"))
def d14_apply_fills(spark, d):
    """Every third slot has an override, every third a fill that had several candidates, which is left out."""
    tracks = B.masked(spark, d)
    places = tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("token_index"))
    fills = places.select("track_id", "token_index", F.lit("x").alias("word"), F.when(F.col("token_index") % 3 == 2, F.array(F.lit("x"), F.lit("z"))).otherwise(F.array(F.lit("x"))).alias("candidates"))
    overrides = places.select("track_id", "token_index", F.when(F.col("token_index") % 3 == 0, "y").otherwise("").alias("word"))
    return U.apply_fills(tracks, fills, overrides=overrides, ambiguous=False).select("track_id", F.md5("text").alias("digest"))


@R.add(_q(RULES, "SELECT rule_id AS template, 'removed' AS change FROM rules WHERE support < 10 UNION ALL SELECT rule_id, 'candidates' FROM rules WHERE support >= 10 AND len(candidates) > 2"))
def d15_diff_rules(spark, d):
    old = rules(spark, d).withColumnRenamed("rule_id", "template")
    new = old.where("support >= 10").withColumn("candidates", F.slice("candidates", 1, 2))
    return U.diff_rules(old, new)


@R.add(_q(MATCHES, "SELECT DISTINCT track_id FROM matches JOIN rules USING (rule_id) WHERE support < 10"))
def d16_affected_tracks(spark, d):
    return U.affected_tracks(matches(spark, d), rules(spark, d).where("support < 10"))


@R.add(_q(PRIORS, "SELECT rule_id, word, p, margin, support FROM priors"))
def d17_estimate_priors(spark, d):
    return U.estimate_priors(matches(spark, d))


@R.add(_q(DECIDED, """SELECT p.track_id, p.token_index, coalesce(p.word, l.w) AS word FROM predictions p LEFT JOIN
    (SELECT track_id, token_index, min(candidates[1]) AS w FROM matches GROUP BY ALL HAVING count(DISTINCT candidates[1]) = 1) l USING (track_id, token_index)"""))
def d18_context_fallback(spark, d):
    local = matches(spark, d).select("track_id", "token_index", F.get("candidates", F.lit(0)).alias("word"))
    return U.context_fallback(predictions(spark, d), local).select("track_id", "token_index", "word")


@R.add(_q(RULES, "SELECT rule_id, tier FROM rules"))
def d19_rule_inventory(spark, d):
    own = rules(spark, d).select("rule_id", "tier", "ord", "candidates")
    return U.rule_inventory(own, own.withColumn("tier", F.lit("frame"))).select("rule_id", "tier")


@R.add(r"""SELECT conv_id, turn, coalesce(regexp_matches(regexp_replace(text, '(?i)\b(from|that|this|with)\b', '[__]', 'g'), '(?i)(^|[^\p{L}\p{N}_''’])\[__\][\s,"“”]+the($|[^\p{L}\p{N}_''’])'), false) AS matched FROM conversations""")
def d20_pattern_match(spark, d):
    contexts = B.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"(?i)\b(from|that|this|with)\b", "[__]").alias("context"))
    return U.pattern_match(contexts, "[that] the").select("conv_id", "turn", "matched")
