"""Queries over the scalar text functions (B) and the slot operators (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotloom.functions import text as T
from slotloom.operators import slots as S
from slotloom.operators import vocabulary as V
from slotloom.plans import base as B
from slotloom.plans.registry import Registry
from slotloom.sources.scratch import cut

R = Registry()
DOCS = "documents"
_MARKED = "regexp_replace(text, '(?i)\\b(from|that|this|with)\\b', '[ __ ]', 'g')"


def _marked(spark, d):
    """Documents with loose markers in place of the test lexicon."""
    return B.table(spark, d, DOCS).select("doc_id", F.regexp_replace("text", r"(?i)\b(from|that|this|with)\b", "[ __ ]").alias("text"))


_SQLM = f"SELECT doc_id, {_MARKED} AS text FROM documents"
_NORM = r"regexp_replace(replace(text, chr(160), ' '), '\[\s*__\s*\]', '[__]', 'g')"


@R.add(f"SELECT conv_id, array_to_string(list(coalesce(text, '') ORDER BY turn, text), '') AS text FROM conversations GROUP BY conv_id")
def b1_event_text(spark, d):
    segs = B.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("utf8")))).alias("segs"))
    return segs.select("conv_id", T.event_text("segs").alias("text"))


@R.add(f"SELECT doc_id, md5({_NORM}) AS digest FROM ({_SQLM})")
def b2_normalize_mask(spark, d):
    return _marked(spark, d).select("doc_id", F.md5(T.normalize_mask("text")).alias("digest"))


@R.add(rf"SELECT doc_id, len(regexp_extract_all({_NORM}, '\[__\]'))::INT AS n FROM ({_SQLM})")
def b3_count_mask(spark, d):
    return _marked(spark, d).select("doc_id", T.count_mask("text").alias("n"))


@R.add(r"""SELECT conv_id, turn, trim(regexp_replace(replace(regexp_replace(replace('[' || role || '] ' || text || ' [__]', '[__]', chr(1)), '\[[^\]\[]*\]', ' ', 'g'), chr(1), '[__]'), ' +', ' ', 'g'), ' ') AS text FROM conversations""")
def b4_strip_labels(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", T.strip_labels(F.concat(F.lit("["), "role", F.lit("] "), "text", F.lit(" [__]"))).alias("text"))


@R.add(rf"SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower({_NORM}), '(\*|\[__\]|[\p{{L}}\p{{N}}_'']+)', 1) AS w FROM ({_SQLM}))")
def b5_rule_words(spark, d):
    return _marked(spark, d).select("doc_id", T.rule_words("text").alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@R.add("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '([a-z0-9]+(?:''[a-z0-9]+)*)', 1)) AS word FROM documents) GROUP BY word")
def b6_lexical_words(spark, d):
    return B.table(spark, d, DOCS).select(F.explode(T.lexical_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@R.add(r"""WITH t AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\[[^\]\n]*\]', ' ', 'g'), '>{2,}', ' ', 'g'), '[♪♫]', ' ', 'g'), '</?[A-Za-z][^>\n]*>', ' ', 'g'), '\s'), lambda w: w <> '') AS w FROM pages)
    SELECT page_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS digest FROM t""")
def b7_discovery_tokens(spark, d):
    rows = B.table(spark, d, "pages").select("page_id", F.explode(F.array(T.discovery_tokens("html"))).alias("t"))
    return rows.select("page_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("t", lambda t: t["token"]), " ")).alias("digest"))


VARIANTS = [("w/", "with "), ("th[a4]t", "that"), ("fr[o0]m", "from")]


@R.add("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), 'w/', 'with ', 'g'), 'th[a4]t', 'that', 'g'), 'fr[o0]m', 'from', 'g')) AS digest FROM documents")
def b8_normalize_variants(spark, d):
    return B.table(spark, d, DOCS).select("doc_id", F.md5(T.normalize_variants("text", VARIANTS)).alias("digest"))


@R.add("""SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(range(0, len(w)))::INT AS pos, unnest(w) AS word FROM
    (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+(?:''[a-z0-9]+)*)', 1) AS w FROM documents)) WHERE word IN ('with', 'this', 'from', 'that')""")
def b9_extract_lexicon(spark, d):
    return V.extract_lexicon(B.table(spark, d, DOCS), B.lexicon(spark), key="doc_id").select("doc_id", "pos", F.col("label").alias("word"))


@R.add(B.sql("features", body="""SELECT track_id, token_index, CASE WHEN expected = 'that' AND tok = 'the' THEN 'thatthe' ELSE expected END AS label FROM features WHERE off = 1"""))
def b10_normalize_compound(spark, d):
    rows = B.labelled(spark, d).select("track_id", "token_index", "expected", F.get(F.filter("features", lambda f: f["off"] == 1), F.lit(0))["tok"].alias("visible"))
    compound = spark.range(1).select(F.lit("that").alias("label"), F.lit("right").alias("side"), F.lit("the").alias("visible"), F.lit("thatthe").alias("out"))
    labels = rows.select("track_id", "token_index", F.col("expected").alias("label"), F.lit(None).cast("string").alias("left"), F.col("visible").alias("right"))
    return V.normalize_compound(labels, compound).select("track_id", "token_index", "label")


@R.add(B.sql("features", body="""SELECT track_id, token_index, coalesce(trim(lower(tok)) = expected, false) AS ok FROM features WHERE off = -1"""))
def b11_answers_match(spark, d):
    rows = B.labelled(spark, d).select("track_id", "token_index", F.array("expected").alias("expected"), F.get(F.filter("features", lambda f: f["off"] == -1), F.lit(0))["tok"].alias("p"))
    return rows.select("track_id", "token_index", T.answers_match("p", "expected").alias("ok"))


@R.add(r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key FROM benchmark")
def b12_context_key(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", T.context_key("text").alias("key"))


@R.add("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'name:' || lower(c_name) END AS key FROM customer")
def b13_creator_key(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", T.creator_key(F.lit(""), F.when(F.col("c_custkey") % 7 == 0, "N/A").otherwise(F.col("c_name"))).alias("key"))


@R.add("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name FROM customer")
def b14_clean_metadata(spark, d):
    return B.table(spark, d, "customer").select("c_custkey", T.clean_metadata(F.when(F.col("c_custkey") % 7 == 0, " unknown ").otherwise(F.concat(F.lit(" "), "c_name"))).alias("name"))


@R.add("SELECT source, (('0x' || substr(sha256('name:' || source), 1, 8))::BIGINT % 5)::INT AS fold, (('0x' || substr(sha256('split-v1|' || source), 1, 2))::INT % 2)::INT AS half, count(*) AS n FROM documents GROUP BY source")
def b15_hash_fold(spark, d):
    rows = B.table(spark, d, DOCS).groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", T.hash_fold(F.concat(F.lit("name:"), "source"), 5).alias("fold"), T.half_fold("source", "split-v1|").alias("half"), "n")


@R.add("""SELECT page_id, lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36)) AS fp FROM pages""")
def b16_content_fingerprint(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.content_fingerprint("url").alias("fp"))


@R.add(B.sql("features", body="SELECT track_id, token_index, expected = 'this' OR expected = 'that' AND starts_with(tok, 'the') AS ok FROM features WHERE off = 1"))
def b11_compound_answers(spark, d):
    """``this`` for every slot; it stands for ``that`` where ``the`` follows."""
    rows = B.labelled(spark, d).select("track_id", "token_index", F.array("expected").alias("expected"), F.concat(F.lit("[__] "), F.get(F.filter("features", lambda f: f["off"] == 1), F.lit(0))["tok"]).alias("near"))
    return rows.select("track_id", "token_index", T.answers_match(F.lit("this"), "expected", context="near", compounds=[("this", "that", "", "the")]).alias("ok"))


@R.add("""SELECT source, sha256(array_to_string(list_sort(list(DISTINCT id)), chr(10))) AS members FROM (SELECT source, 'doc:' || substr(sha256(source || chr(0) || doc_id), 1, 20) AS id FROM documents) GROUP BY source""")
def b17_stable_id(spark, d):
    rows = B.table(spark, d, DOCS).select("source", T.stable_id("doc", "source", "doc_id").alias("id"))
    return rows.groupBy("source").agg(T.membership_hash(F.col("id")).alias("members"))


_AROUND = r"""a AS (SELECT conv_id, turn, unnest(range(0, len(p) - 1))::INT AS k, p FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '(?i)\b(from|that|this|with)\b', '[__]', 'g'), '[__]') AS p FROM conversations)),
    s AS (SELECT conv_id, turn, k, array_to_string(p[1:k + 1], '[__]') AS before, array_to_string(p[k + 2:], '[__]') AS after FROM a)"""


def _around(spark, d):
    """Every marker of every turn with the whole text before and after it."""
    parts = F.split(F.regexp_replace("text", r"(?i)\b(from|that|this|with)\b", "[__]"), r"\[__\]", -1)
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array(parts)).alias("p"))
    rows = rows.select("conv_id", "turn", "p", F.explode(F.slice(F.sequence(F.lit(0), F.size("p")), 1, F.size("p") - 1)).alias("k"))
    side = lambda a, n: F.array_join(F.slice("p", a, n), "[__]")
    return rows.select("conv_id", "turn", "k", side(F.lit(1), F.col("k") + 1).alias("before"), side(F.col("k") + 2, F.size("p")).alias("after"))


@R.add(f"WITH {_AROUND}, " + r"""l AS (SELECT *, list_filter(regexp_extract_all(before, '([A-Za-z]+(?:[''’][A-Za-z]+)*)', 1), lambda w: len(w) > 1) AS w FROM s)
    SELECT conv_id, turn, k, CASE WHEN coalesce(regexp_matches(w[-1], '^[A-Z''’]+$'), false) THEN 'WORD' WHEN regexp_matches(before, '[.!?]\s*$') THEN 'Word' ELSE 'word' END AS word FROM l""")
def b18_format_case(spark, d):
    return _around(spark, d).select("conv_id", "turn", "k", T.format_case(F.lit("word"), "before").alias("word"))


_OPENS = r"""(regexp_matches(after, '^\s*>>') OR regexp_matches(after, '^\s*["''(\[]*(I\b|[A-Z][a-z]|[A-Z]{2,}\s+[a-z])'))"""
_GOES_ON = r"""regexp_matches(before, '(?i)(?:whatever|what|how|why|where|who|when)\s+the\s*$') AND regexp_matches(after, '^\s*(?:I|you|he|she|they|we|it)\b')"""


@R.add(f"WITH {_AROUND} SELECT conv_id, turn, k, 'word' || CASE WHEN regexp_matches(after, '^[.!?]') THEN substr(after, 1, 1) WHEN {_OPENS} AND NOT ({_GOES_ON}) THEN '.' ELSE '' END AS word FROM s")
def b19_format_punct(spark, d):
    return _around(spark, d).select("conv_id", "turn", "k", T.format_punct(F.lit("word"), "before", "after").alias("word"))


@R.add(rf"""SELECT track_id, token_index, {_OPENS} AND NOT regexp_matches(after, '^\s*[.!?]') AND NOT regexp_matches(before, '(?i)\b(?:go|going|went|gone)\s+to\s*$') AND NOT ({_GOES_ON}) AS ends
    FROM (SELECT track_id, token_index, substr(text, 1, char_off) AS before, substr(text, char_off + 5) AS after FROM slots)""", "slots")
def b20_virtual_punct(spark, d):
    head, tail = F.substring(F.col("text"), F.lit(1), F.col("char_off")), F.substring(F.col("text"), F.col("char_off") + 5, F.lit(1 << 20))
    return B.slots(spark, d).select("track_id", "token_index", T.virtual_break(head, tail).alias("ends"))


# Tracks without stops, as captions often are: a title-case word right after a slot then opens a sentence.
_BARE = "bare AS MATERIALIZED (SELECT track_id, creator, pair_class, regexp_replace(text, '[.!?]', '', 'g') AS text, original FROM masked), words AS MATERIALIZED (" + B.CTES["words"].replace("FROM masked", "FROM bare") + "), labelled AS MATERIALIZED (" + B.CTES["labelled"] + "), "
# Words before a slot that only white space parts from it and each other, two and four of them.
_LEAD = r"""lead AS MATERIALIZED (SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY spot) - 1)::INT AS token_index,
    CASE WHEN near AND spot >= 2 AND regexp_full_match(g[spot], '\s*') THEN w[spot - 1] || ' ' || w[spot] END AS p2,
    CASE WHEN near AND spot >= 4 AND regexp_full_match(g[spot], '\s*') AND regexp_full_match(g[spot - 1], '\s*') AND regexp_full_match(g[spot - 2], '\s*') THEN w[spot - 3] || ' ' || w[spot - 2] || ' ' || w[spot - 1] || ' ' || w[spot] END AS p4
    FROM (SELECT *, regexp_full_match(g[spot + 1], '\s*') AS near FROM (SELECT *, unnest(range(0, len(w)))::INT AS spot FROM words) WHERE w[spot + 1] = '[__]')),
    two AS (SELECT p2 FROM lead GROUP BY p2 HAVING count(p2) >= 20), four AS (SELECT p4 FROM lead GROUP BY p4 HAVING count(p4) >= 2)"""


@R.add(B.sql("masked", more=_BARE + _LEAD, body="""SELECT track_id, token_index, breaks AS opens, breaks AND two.p2 IS NULL AND four.p4 IS NULL AS breaks
    FROM labelled JOIN lead USING (track_id, token_index) LEFT JOIN two ON lead.p2 = two.p2 LEFT JOIN four ON lead.p4 = four.p4"""))
def b20_continuing_phrases(spark, d):
    """Sentence ends at slots of tracks without stops, before and after phrases guard: pairs of words that 20 slots follow,
    fours that two follow."""
    slots = cut(S.slot_features(B.masked(spark, d).select("track_id", F.regexp_replace("text", "[.!?]", "").alias("text")), 1, 1, lead=4).select("track_id", "token_index", "breaks", "lead"), "led-slots")

    def frequent(k, least):
        rows = slots.where(F.size("lead") >= k).groupBy(F.array_join(F.reverse(F.slice("lead", 1, k)), " ").alias("phrase")).agg(F.count("*").alias("n"))
        return rows.where(F.col("n") >= least).select("phrase")

    paths = cut(S.phrase_paths(frequent(2, 20).union(frequent(4, 2))), "phrase-paths")
    return S.continues(slots.withColumn("opens", F.col("breaks")), paths).select("track_id", "token_index", "opens", "breaks")


@R.add(B.sql("labelled", body="SELECT a.expected AS a, b.expected AS b, count(*) AS n FROM labelled a JOIN labelled b ON a.track_id = b.track_id AND b.token_index = a.token_index + 1 WHERE a.expected <> b.expected AND (a.expected IN ('this', 'that')) = (b.expected IN ('this', 'that')) GROUP BY ALL"))
def b21_same_family(spark, d):
    families = {"with": "preposition", "from": "preposition", "this": "pointer", "that": "pointer"}
    fam = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("word"), F.lit(v).alias("family")) for k, v in families.items()])).alias("f")).select("f.*")
    rows = B.labelled(spark, d).select("track_id", "token_index", F.col("expected").alias("a"))
    later = rows.select("track_id", (F.col("token_index") - 1).alias("token_index"), F.col("a").alias("b"))
    pairs = V.same_family(rows.join(later, ["track_id", "token_index"]), fam)
    return pairs.where("same_family").groupBy("a", "b").agg(F.count("*").alias("n"))


@R.add(rf"SELECT doc_id, len(regexp_extract_all({_NORM}, '(\[__\]|[\p{{L}}\p{{N}}'']+)'))::INT AS units FROM ({_SQLM})")
def b22_spoken_units(spark, d):
    return _marked(spark, d).select("doc_id", T.spoken_units("text").alias("units"))


@R.add("SELECT pair_class, creator, count(*) AS n FROM tracks WHERE pair_class IN ('manual-auto', 'synthetic') AND creator IS NOT NULL GROUP BY ALL", "tracks")
def b23_row_predicates(spark, d):
    rows = B.tracks(spark, d).where(V.tier("pair_class").isNotNull() & V.known_creator(F.lit(""), "creator"))
    return rows.groupBy("pair_class", "creator").agg(F.count("*").alias("n"))


@R.add("SELECT track_id, token_index, event_index, slot_in_event, char_off FROM slots", "slots")
def c1_extract_slots(spark, d):
    return B.slots(spark, d).select("track_id", "token_index", "event_index", "slot_in_event", "char_off")


def _user_events(spark, d):
    rows = B.table(spark, d, "events")
    ms = F.lit(1704067200000) + F.timestamp_diff("MILLISECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "ts")
    return rows.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("event_index"), ms.alias("start_ms"), (F.round(F.col("value") * 1000) - 10000).cast("bigint").alias("dur_ms"), F.col("event_type").alias("text"))


_UE = "ue AS (SELECT user_id AS track_id, event_id AS event_index, epoch_us(ts) // 1000 AS start_ms, (round(value * 1000) - 10000)::BIGINT AS dur_ms, event_type AS text FROM events)"


@R.add(f"""WITH {_UE}, n AS (SELECT *, min(start_ms) OVER (PARTITION BY track_id ORDER BY event_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start_ms FROM ue)
    SELECT track_id, event_index, next_start_ms, CASE WHEN next_start_ms IS NOT NULL AND (dur_ms <= 0 OR event_index % 2 = 0 AND start_ms + dur_ms > next_start_ms) THEN next_start_ms - start_ms ELSE dur_ms END AS fixed_dur_ms FROM n""")
def c2_event_durations(spark, d):
    return S.event_durations(_user_events(spark, d).withColumn("fixed_page", F.col("event_index") % 2 == 0)).select("track_id", "event_index", "next_start_ms", "fixed_dur_ms")


@R.add("SELECT track_id, token_index, time_s FROM timed", "timed")
def c3_slot_times(spark, d):
    return S.slot_times(B.slots(spark, d)).select("track_id", "token_index", "time_s")


@R.add(r"""WITH s AS (SELECT conv_id, turn, coalesce(regexp_replace(text, '(?i)\b(from|that|this|with)\b', '[__]', 'g'), '') || ' ' AS text FROM conversations),
  e AS (SELECT conv_id AS track_id, array_to_string(list(text ORDER BY turn, text), '') AS text FROM s GROUP BY conv_id),
  o AS (SELECT conv_id AS track_id, turn, text AS seg, coalesce(sum(len(string_split(text, '[__]')) - 1) OVER w, 0)::INT AS base, coalesce(sum(length(text)) OVER w, 0) AS before FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT track_id, turn, base, before, unnest(range(0, len(string_split(seg, '[__]')) - 1)) AS k, string_split(seg, '[__]') AS p FROM o),
  c AS (SELECT track_id, turn, (base + k)::INT AS token_index, before + length(array_to_string(p[1:k + 1], '[__]')) AS char_off FROM k)
  SELECT track_id, token_index, CASE WHEN turn % 2 = 0 THEN turn * 1000.0 / 1000.0 ELSE 60000.0::DOUBLE * len(regexp_extract_all(substr(text, 1, char_off::BIGINT), '(\[__\]|[\p{L}\p{N}'']+)')) / greatest(len(regexp_extract_all(text, '(\[__\]|[\p{L}\p{N}'']+)')), 1) / 1000.0 END::DOUBLE AS time_s FROM c JOIN e USING (track_id)""")
def c3_segment_times(spark, d):
    """A conversation as an event of one minute, its turns as segments, of which every other one has an offset."""
    text = F.concat(F.coalesce(F.regexp_replace("text", r"(?i)\b(from|that|this|with)\b", "[__]"), F.lit("")), F.lit(" "))
    turns = B.table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    held = turns.groupBy(F.col("conv_id").alias("track_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    segs = F.transform("turns", lambda t: F.struct(t["text"].alias("utf8"), F.when(t["turn"] % 2 == 0, t["turn"].cast("bigint") * 1000).alias("tOffsetMs")))
    events = held.select("track_id", F.lit(0).alias("event_index"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(60_000).cast("bigint").alias("dur_ms"), T.event_text(segs).alias("text"), segs.alias("segs"))
    return S.slot_times(S.extract_slots(events)).select("track_id", "token_index", "time_s")


@R.add(f"""WITH {_UE} SELECT track_id, event_index, start_ms / 1000.0::DOUBLE AS start_s, CASE WHEN dur_ms > 0 THEN start_ms + dur_ms ELSE coalesce(lead(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms, event_index), start_ms + 5000) END / 1000.0::DOUBLE AS end_s FROM ue""")
def c4_timeline(spark, d):
    return S.timeline(_user_events(spark, d)).drop("text")


_CTX = """vis AS (SELECT * FROM events WHERE trim(text, ' ') <> ''),
  ctx AS (SELECT track_id, event_index, array_to_string(list(text) OVER w, ' ') AS context, coalesce(sum(n) OVER p, 0)::BIGINT AS marks_before FROM vis
    WINDOW w AS (PARTITION BY track_id ORDER BY event_index ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING), p AS (PARTITION BY track_id ORDER BY event_index ROWS BETWEEN {b} PRECEDING AND 1 PRECEDING))"""


@R.add(B.sql("slots", more=_CTX.format(b=1, a=0), body="SELECT track_id, token_index, md5(context) AS digest FROM slots JOIN ctx USING (track_id, event_index)"))
def c5_slot_context(spark, d):
    return S.slot_context(B.slots(spark, d), B.events(spark, d), 1, 0).select("track_id", "token_index", F.md5("context").alias("digest"))


@R.add(B.sql("slots", more=_CTX.format(b=1, a=1) + """, fl AS (SELECT track_id, event_index, list(CASE WHEN token_index % 3 = 0 THEN 'word' || token_index ELSE '…' END ORDER BY token_index) AS f FROM slots GROUP BY ALL),
  ar AS (SELECT track_id, event_index, flatten(list(coalesce(f, [])) OVER (PARTITION BY track_id ORDER BY event_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS f FROM vis LEFT JOIN fl USING (track_id, event_index)),
  pt AS (SELECT track_id, token_index, marks_before + slot_in_event AS k, string_split(context, '[__]') AS p, f FROM slots JOIN ctx USING (track_id, event_index) JOIN ar USING (track_id, event_index))""",
    body="SELECT track_id, token_index, md5(p[1] || array_to_string(list_transform(range(1, len(p)), lambda i: CASE WHEN i = k + 1 THEN '[__]' ELSE f[i] END || p[i + 1]), '')) AS digest FROM pt"))
def c5_filled_context(spark, d):
    rows = B.slots(spark, d)
    fills = rows.where("token_index % 3 = 0").select("track_id", "token_index", F.concat(F.lit("word"), F.col("token_index").cast("string")).alias("word"))
    return S.filled_context(rows, B.events(spark, d), fills, 1, 1).select("track_id", "token_index", F.md5("context").alias("digest"))


@R.add(B.sql("slots", more=_CTX.format(b=1, a=0), body="SELECT track_id, token_index, (marks_before + slot_in_event)::INT AS slot_index, len(regexp_extract_all(context, '\\[__\\]'))::INT AS marks FROM slots JOIN ctx USING (track_id, event_index)"))
def c6_original_context(spark, d):
    return S.slot_context(B.slots(spark, d), B.events(spark, d), 1, 0).select("track_id", "token_index", "slot_index", T.count_mask("context").alias("marks"))


@R.add(B.sql("slots", more=_CTX.format(b=2, a=2) + """, parts AS (SELECT track_id, token_index, (marks_before + slot_in_event)::INT AS k, string_split(context, '[__]') AS p FROM slots JOIN ctx USING (track_id, event_index))""",
    body="SELECT track_id, token_index, md5(array_to_string(p[1:k + 1], '…') || '[__]' || array_to_string(p[k + 2:], '…')) AS digest FROM parts"))
def c7_review_context(spark, d):
    rows = S.slot_context(B.slots(spark, d), B.events(spark, d), 2, 2)
    return rows.select("track_id", "token_index", F.md5(S.only_target("context", "slot_index")).alias("digest"))


@R.add(B.sql("events", more=r"""u AS (SELECT track_id, event_index, start_ms, dur_ms, regexp_extract_all(text, '(\[__\]|[\p{L}\p{N}'']+)') AS us FROM events),
  x AS (SELECT track_id, event_index, start_ms, dur_ms, len(us) AS n, unnest(range(0, len(us))) AS k, unnest(us) AS unit FROM u),
  y AS (SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY event_index, k) - 1)::INT AS position, unit, (start_ms + dur_ms::DOUBLE * k / n) / 1000.0 AS time_s FROM x),
  z AS (SELECT *, round(time_s * 1000)::BIGINT AS ms FROM y),
  v AS (SELECT *, count(*) OVER (PARTITION BY track_id ORDER BY ms RANGE BETWEEN 30000 PRECEDING AND CURRENT ROW) AS near, count(*) OVER (PARTITION BY track_id, ms ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS peers,
    lead(unit) OVER q AS nu, lead(ms) OVER q AS nm FROM z WINDOW q AS (PARTITION BY track_id ORDER BY position))""",
    body="SELECT track_id, position, time_s, near - peers AS preceding, CASE WHEN nm - ms <= 2000 AND nu <> '[__]' THEN lower(nu) END AS next_word FROM v WHERE unit = '[__]'"))
def c8_spoken_context(spark, d):
    return S.spoken_context(S.spoken_lines(B.events(spark, d)))


@R.add()
def c9_sentence_context(spark, d):
    return S.sentence_context(B.masked(spark, d)).select("track_id", "at", "context", "fallback")


@R.add(B.sql("slots", more=_CTX.format(b=0, a=0) + r""", k AS (SELECT DISTINCT lower(trim(regexp_replace(context, '\s+', ' ', 'g'))) AS text FROM slots JOIN ctx USING (track_id, event_index))""",
    body="SELECT 'context:' || substr(sha256(text), 1, 20) AS context_id, len(string_split(text, ' '))::INT AS word_count FROM k"))
def c10_context_dim(spark, d):
    return S.context_dim(S.slotted_contexts(B.slots(spark, d), B.events(spark, d), 0, 0)).select("context_id", "word_count")


@R.add(r"SELECT track_id, len(regexp_extract_all(text, '\[__\]'))::INT AS slots, md5(text) AS digest FROM masked", "masked")
def c11_mask_lexicon(spark, d):
    return B.masked(spark, d).select("track_id", "slots", F.md5("text").alias("digest"))


@R.add(B.sql("timed", more="""w AS (SELECT track_id, min(time_s) AS f, 0 AS no FROM timed GROUP BY track_id UNION ALL SELECT w.track_id, min(t.time_s), w.no + 1 FROM w JOIN timed t ON t.track_id = w.track_id AND t.time_s > w.f AND t.time_s + 1.5 > w.f - 3 + 30 GROUP BY w.track_id, w.no)""",
    body="SELECT track_id, token_index, no AS window_no, f - 3 AS opens FROM (SELECT t.track_id, token_index, no, f, row_number() OVER (PARTITION BY t.track_id, token_index ORDER BY no DESC) AS k FROM timed t JOIN w ON t.track_id = w.track_id AND w.f <= t.time_s) WHERE k = 1").replace("WITH ", "WITH RECURSIVE ", 1))
def c12_speech_windows(spark, d):
    return S.speech_windows(S.slot_times(B.slots(spark, d)))


@R.add(B.sql("timed", more="""p AS (SELECT track_id, greatest(floor(time_s - 35), 0)::BIGINT AS a, ceil(time_s + 30)::BIGINT AS b FROM timed),
  f AS (SELECT *, max(b) OVER (PARTITION BY track_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM f)""",
    body="SELECT track_id, min(a) AS start_s, max(b) AS end_s, count(*) AS n FROM i GROUP BY track_id, g"))
def c13_merge_intervals(spark, d):
    return S.merge_intervals(S.slot_times(B.slots(spark, d)))
