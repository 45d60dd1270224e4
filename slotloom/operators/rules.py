"""Rules: expansion, matching, precedence and fills.

A rule table has rule_id, group_id, tier, ord, lefts and rights (arrays of (off, tok) conditions around a slot),
candidates, and anchor_off, anchor_tok: the condition that matches are joined on. Rules are broadcast up to a number that
is counted, for estimates do not see what an explode makes of a small file; slots never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions import text as T
from slotloom.operators.sampling import numbered
from slotloom.sources.scratch import cut

TIERS = ["exact", "productive", "low", "frame", "fallback"]
ALTERNATIVES = r"\[([^\]\[]*\|[^\]\[]*)\]"


def expand_rules(patterns: DataFrame) -> DataFrame:
    """(group_no, pattern_no, parts array<array<string>>) -> one row for each choice of one word a part, with its
    template and ord = group * 1e9 + pattern * 1e6 + expansion."""
    # The product of a pattern's parts, the last part moving fastest.
    product = F.aggregate("parts", F.array(F.array().cast("array<string>")), lambda acc, part: F.flatten(F.transform(acc, lambda a: F.transform(part, lambda w: F.concat(a, F.array(w))))))
    rows = patterns.select("group_no", "pattern_no", F.posexplode(product).alias("expansion", "words"))
    ord_ = F.col("group_no").cast("bigint") * 1_000_000_000 + F.col("pattern_no") * 1_000_000 + F.col("expansion")
    return rows.select("group_no", "pattern_no", F.array_join("words", " ").alias("template"), ord_.alias("ord"))


def duplicate_templates(expanded: DataFrame) -> DataFrame:
    """Templates that come up more than once."""
    return expanded.groupBy("template").agg(F.count("*").alias("n")).where("n > 1")


def compile_rules(templates: DataFrame) -> DataFrame:
    """Templates such as ``^ with [this|that] * end $`` -> candidates, blanks, conditions and anchors.

    The bracket holds the candidates, separated by bars; a candidate of several words takes as many blanks. ``^`` and
    ``$`` bind to the text's start and end, ``*`` is any one word, ``<name>`` one word of that class (``classes``: off, cls),
    ``[__]`` a blank that is kept, and a trailing ``…`` lets the text go on.
    """
    # Candidates may hold spaces: they are cut out first and stand as one token.
    inner = F.regexp_extract("template", ALTERNATIVES, 1)
    flat = F.filter(F.split(F.regexp_replace("template", ALTERNATIVES, "<slot>"), " +"), lambda t: (t != "") & (t != "…"))
    rows = templates.select(*templates.columns, F.split(inner, r"\|").alias("candidates"), F.explode(F.array(flat)).alias("toks"))
    at = F.array_position("toks", "<slot>") - 1
    body = F.transform("toks", lambda t, i: F.struct((i - at).cast("int").alias("off"), F.when(t == "^", "<BOS>").when(t == "$", "<EOS>").otherwise(F.lower(t)).alias("tok")))
    named = lambda c: c["tok"].rlike("^<[a-z0-9_-]+>$")
    conditions = F.filter(body, lambda c: (c["off"] != 0) & (c["tok"] != "*") & ~named(c))
    classes = F.transform(F.filter(body, lambda c: (c["off"] != 0) & named(c)), lambda c: F.struct(c["off"].alias("off"), F.regexp_extract(c["tok"], "<(.*)>", 1).alias("cls")))
    blanks = F.array_max(F.transform("candidates", lambda c: F.size(F.split(F.trim(c), " +"))))
    kept = F.transform(F.filter(body, lambda c: c["tok"] == "[__]"), lambda c: c["off"])
    return rows.where(F.array_contains("toks", "<slot>")).select(*templates.columns, F.transform("candidates", F.trim).alias("candidates"), blanks.alias("blanks"), conditions.alias("conditions"), classes.alias("classes"), kept.alias("kept"))


def unknown_classes(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules that name a class which has no words. classes: tok, cls."""
    named = rules.select("rule_id", F.explode("classes.cls").alias("cls"))
    return named.join(classes.select("cls").distinct(), "cls", "left_anti")


def with_anchor(rules: DataFrame, counts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The rarest condition of each rule as its anchor; counts: off, tok, n over the slots. Stop words would skew. With
    classes (tok, cls) and rules that name some, a class is as frequent as its words are together, and its anchor is
    ``<cls>``."""
    exploded = rules.select("rule_id", F.explode("conditions").alias("c")).select("rule_id", "c.off", "c.tok")
    counts = counts.select("off", "tok", F.col("n").cast("bigint").alias("n"))
    if classes is not None:
        tag = F.concat(F.lit("<"), "cls", F.lit(">")).alias("tok")
        exploded = exploded.unionByName(rules.select("rule_id", F.explode("classes").alias("c")).select("rule_id", "c.off", "c.cls").select("rule_id", "off", tag))
        counts = counts.unionByName(counts.join(classes.select("tok", "cls").distinct(), "tok").groupBy("off", "cls").agg(F.sum("n").alias("n")).select("off", tag, "n"))
    ranked = exploded.join(counts, ["off", "tok"], "left").select("rule_id", "off", "tok", F.coalesce("n", F.lit(0)).alias("n"))
    best = ranked.groupBy("rule_id").agg(F.min(F.struct("n", "off", "tok")).alias("a"))
    return rules.join(best, "rule_id").select(*rules.columns, F.col("a.off").alias("anchor_off"), F.col("a.tok").alias("anchor_tok"))


def frame_rules(prefixes: DataFrame, suffixes: DataFrame, candidates: Column) -> DataFrame:
    """D3: grammatical frames; set tables (set_id, word) joined on their set, one rule a pair of neighbours."""
    left, right = prefixes.withColumnRenamed("word", "before"), suffixes.withColumnRenamed("word", "after")
    pairs = left.join(right, "set_id")
    conditions = F.array(F.struct(F.lit(-1).alias("off"), F.col("before").alias("tok")), F.struct(F.lit(1).alias("off"), F.col("after").alias("tok")))
    return pairs.select(F.concat_ws(":", F.lit("frame"), "set_id", "before", "after").alias("rule_id"), F.lit("frame").alias("tier"), conditions.alias("conditions"), candidates.alias("candidates"))


def restrict_candidates(rules: DataFrame, emitted: DataFrame) -> DataFrame:
    """Only candidates all of whose words may be emitted; rules without one go."""
    words = rules.select("rule_id", F.posexplode("candidates").alias("k", "candidate")).select("rule_id", "k", "candidate", F.explode(F.split("candidate", " ")).alias("word"))
    known = words.join(emitted.select("word", F.lit(True).alias("ok")).distinct(), "word", "left")
    good = known.groupBy("rule_id", "k", "candidate").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok")
    kept = good.groupBy("rule_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "candidate"))), lambda s: s["candidate"]).alias("candidates"))
    return rules.drop("candidates").join(kept, "rule_id")


#: Words of classes up to which these are broadcast.
WORDS = 1 << 17


def _word_classes(classes: DataFrame) -> DataFrame:
    known = classes.select(F.col("tok").alias("class_tok"), "cls").distinct()
    return F.broadcast(known) if known.limit(WORDS + 1).count() <= WORDS else known


def _in_classes(found: DataFrame, classes: DataFrame, joined: bool) -> DataFrame:
    """D7 within D5: matches all of whose class positions hold a word of their class."""
    key = ["track_id", "token_index", "rule_id"]
    near = lambda f: f["joined"] if joined else F.lit(True)
    some = found.where(F.size("classes") > 0)
    held = some.select(*key, F.explode("classes").alias("c"), "around").select(*key, F.col("c.cls").alias("cls"), F.get(F.filter("around", lambda f: (f["off"] == F.col("c.off")) & near(f)), F.lit(0))["tok"].alias("class_tok"))
    good = held.join(classes, ["cls", "class_tok"], "left_semi").groupBy(*key).agg(F.count("*").alias("__held"))
    return found.where(F.size("classes") == 0).unionByName(some.join(good, key).where(F.col("__held") == F.size("classes")).select(found.columns))


#: Rules up to which these are broadcast.
RULES = 1 << 16


def meet_anchors(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (anchor_off, anchor_tok) with the rules anchored there. The rules are written and counted; over RULES of them
    both sides are shuffled, whatever their estimated size."""
    held = cut(rules, "anchored-rules")
    few = held.count() <= RULES
    return keyed.join(F.broadcast(held) if few else held.hint("merge"), ["anchor_off", "anchor_tok"])


def candidate_matches(slots: DataFrame, rules: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Anchor join, then every other condition and the guard are verified. slots: track_id, token_index,
    features, an array of (off, tok) from -1 to 1 at least; rules may have blanks and kept (else one and none). Where the
    slots have ``breaks``, no rule reaches over the end of a sentence at a slot, unless an exact rule spans it. With classes
    (tok, cls), rules may have class conditions (``classes``) and class anchors: one call matches all templates of a table."""
    held = ["breaks"] if "breaks" in slots.columns else []
    keyed = slots.select("track_id", "token_index", *held, F.col("features").alias("around"), F.explode("features").alias("f")).select("track_id", "token_index", *held, "around", F.col("f.off").alias("anchor_off"), F.col("f.tok").alias("anchor_tok"))
    has_joined = "joined" in slots.schema["features"].dataType.elementType.names
    if classes is not None:
        classes = _word_classes(classes)
        tagged = keyed.join(classes, keyed["anchor_tok"] == classes["class_tok"]).withColumn("anchor_tok", F.concat(F.lit("<"), "cls", F.lit(">"))).select(keyed.columns)
        keyed = keyed.unionByName(tagged)
    joined = meet_anchors(keyed, rules)
    found = joined.where(verify_match("conditions", "around", has_joined) & adjacent_guard("around", rules.columns))
    if classes is not None and "classes" in rules.columns:
        found = _in_classes(found, classes, has_joined)
    found = found.drop("around", "anchor_off", "anchor_tok")
    if not held:
        return found
    reaches = F.exists("conditions", lambda c: c["off"] > 0)
    if "classes" in rules.columns:
        reaches = reaches | F.exists("classes", lambda c: c["off"] > 0)
    exact = F.col("tier") == "exact" if "tier" in rules.columns else F.lit(False)
    spanned = F.bool_or(exact & reaches).over(Window.partitionBy("track_id", "token_index"))
    return found.withColumn("spanned", spanned).where(~F.col("breaks") | ~reaches | F.col("spanned")).drop("breaks", "spanned")


def verify_match(conditions: str, around: str, joined: bool = False) -> Column:
    """Every condition stands among the (off, tok) pairs around the slot; with ``joined``, no sign that a rule may not
    pass stands between."""
    near = lambda f: f["joined"] if joined else F.lit(True)
    return F.forall(conditions, lambda c: F.exists(around, lambda f: (f["off"] == c["off"]) & (f["tok"] == c["tok"]) & near(f)))


def adjacent_guard(around: str, columns: list[str]) -> Column:
    """False where a rule of one blank stands at a slot right beside another slot, unless the rule keeps a blank."""
    touching = F.exists(around, lambda f: f["off"].isin(-1, 1) & (f["tok"] == "[__]"))
    free = F.col("blanks") > 1 if "blanks" in columns else F.lit(False)
    keeps = F.size("kept") > 0 if "kept" in columns else F.lit(False)
    return ~touching | free | keeps


def class_filter(matches: DataFrame, tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """Matches whose class positions hold a word of the class. tokens: track_id, token_index, off, tok;
    matches need class_off and class_name; classes: class_name, tok."""
    held = matches.join(tokens.withColumnRenamed("off", "class_off"), ["track_id", "token_index", "class_off"])
    return held.join(classes, ["class_name", "tok"], "left_semi")


def tier_rank(tier: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier) if isinstance(tier, str) else tier)


def rule_order(rules: DataFrame) -> DataFrame:
    """Place of every rule: by tier, fallback rules by priority, then ord."""
    ranked = rules.withColumn("tier_rank", tier_rank("tier")).withColumn("fallback_priority", F.when(F.col("tier") == "fallback", F.col("priority")).otherwise(0))
    placed = numbered(ranked, "tier_rank", F.desc("fallback_priority"), "ord", "rule_id", name="place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int")).drop("tier_rank", "fallback_priority")


def resolve_single(matches: DataFrame) -> DataFrame:
    """D9 for one-slot rules: the first match of a slot holds it, also when it abstains."""
    w = Window.partitionBy("track_id", "token_index").orderBy("ord", "rule_id")
    return matches.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def resolve_overlaps(matches: DataFrame) -> DataFrame:
    """In ord order the first match claims its span of slots (token_index, span) and blocks those that overlap it; rows that
    are equal count once.

    Most matches are told by their neighbours: one that comes before all it overlaps claims its span, whatever else happens,
    and its rivals leave. ``_CLAIMS`` such rounds are windows over single slots, which no component or track binds
    together. What still waits (chains in which each match depends on the one before) is streamed in order of ord, a
    component of overlapping spans at a time, with the slots claimed so far as the only state: linear in its matches."""
    order = ["ord", "rule_id", "token_index", "span"]
    left = matches.select("track_id", F.col("token_index").cast("int").alias("token_index"), F.col("span").cast("int").alias("span"), F.col("rule_id").cast("string").alias("rule_id"), F.col("ord").cast("bigint").alias("ord")).dropDuplicates()
    key, by_slot = F.struct(*order), Window.partitionBy("track_id", "slot")
    slots = F.explode(F.sequence(F.col("token_index"), F.col("token_index") + F.greatest(F.col("span"), F.lit(1)) - 1)).alias("slot")
    won = None
    for _ in range(_CLAIMS):
        placed = left.select("*", slots).withColumn("first", F.min(key).over(by_slot))
        told = placed.withColumn("own", F.col("first") == key).groupBy("track_id", *order).agg(F.bool_and("own").alias("claims"), F.collect_set("first").alias("rivals"))
        # A rival that claims is the first of one of this match's slots; a match has as many rivals as slots at most.
        told = cut(told, "claims")
        now = told.where("claims").select("track_id", *order)
        won = now if won is None else won.unionByName(now)
        blocked = told.where("NOT claims").select("track_id", *order, F.explode("rivals").alias("r")).join(now.select("track_id", F.struct(*order).alias("r")), ["track_id", "r"], "left_semi").select("track_id", *order).distinct()
        left = told.where("NOT claims").select("track_id", *order).join(blocked, ["track_id", *order], "left_anti")
    return won.unionByName(_in_turn(left).select("track_id", *order)).select("track_id", "token_index", "span", "rule_id", "ord")


#: Rounds in which matches claim their spans side by side.
_CLAIMS = 2


def _in_turn(matches: DataFrame) -> DataFrame:
    """The matches that claim their span when they come one after the other, by component of overlapping spans."""
    order = Window.partitionBy("track_id").orderBy("token_index", "span", "ord", "rule_id")
    reach = F.max(F.col("token_index") + F.greatest(F.col("span"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = matches.withColumn("new", F.when(reach.isNull() | (F.col("token_index") >= reach), 1).otherwise(0))
    parts = parts.withColumn("component", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, set()
        for batch in batches:
            keep = []
            for *key, at, span in zip(*(batch.column(c).to_pylist() for c in ("track_id", "component", "token_index", "span"))):
                if key != group:
                    group, taken = key, set()
                own = range(at, at + max(span, 1))
                keep.append(taken.isdisjoint(own))
                if keep[-1]:
                    taken.update(own)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = parts.drop("new").repartition("track_id", "component").sortWithinPartitions("track_id", "component", "ord", "rule_id", "token_index", "span")
    return dealt.mapInArrow(run, dealt.schema)


def adjacent_slots(slots: DataFrame) -> DataFrame:
    """Slots that stand right beside another slot (column at: word position)."""
    w = Window.partitionBy("track_id").orderBy("at")
    near = (F.col("at") - F.lag("at").over(w) == 1) | (F.lead("at").over(w) - F.col("at") == 1)
    return slots.withColumn("adjacent", F.coalesce(near, F.lit(False)))


def decide(matches: DataFrame, priors: DataFrame, policy: str = "score", least: float = 0.0) -> DataFrame:
    """One candidate fills; of several, the prior's word (from a share of ``least`` on), the first, or none."""
    scored = matches.join(priors.select("rule_id", F.col("word").alias("prior_word"), "p"), "rule_id", "left")
    several = {"first": F.get("candidates", F.lit(0)), "abstain": F.lit(None).cast("string"), "score": F.when((F.col("p") >= least) & F.array_contains("candidates", F.col("prior_word")), F.col("prior_word"))}[policy]
    word = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).otherwise(several)
    source = F.when(F.size("candidates") == 1, "rule").when(word.isNull(), "abstain").otherwise(F.lit("first" if policy == "first" else "paired"))
    return scored.withColumn("word", word).withColumn("source", source).drop("prior_word", "p")


def explode_spans(decisions: DataFrame) -> DataFrame:
    """A fill of several words -> one word a slot; if there are candidates, with their pieces at that slot (a candidate
    of another number of words stays whole) and the word itself."""
    held = ["candidates"] if "candidates" in decisions.columns else []
    span = F.size(F.split("word", " +"))
    rows = decisions.select("track_id", "token_index", "rule_id", *held, span.alias("span"), F.posexplode(F.split("word", " +")).alias("k", "piece"))
    own = lambda c: F.when(F.size(F.split(c, " +")) == F.col("span"), F.get(F.split(c, " +"), F.col("k"))).otherwise(c)
    pieces = [F.array_distinct(F.concat(F.transform("candidates", own), F.array("piece"))).alias("pieces")] if held else []
    return rows.select("track_id", (F.col("token_index") + F.col("k")).cast("int").alias("token_index"), "rule_id", F.col("piece").alias("word"), *pieces)


def trace(slots: DataFrame, matches: DataFrame) -> DataFrame:
    """Every matching rule of a slot as winner, abstain or blocked (and by whom); slots without one too. With the
    decisions' word (D11) a first match abstains where that is null; without, where it has several candidates."""
    w = Window.partitionBy("track_id", "token_index").orderBy("ord", "rule_id")
    ranked = matches.withColumn("rank", F.row_number().over(w)).withColumn("winner", F.first("rule_id").over(w))
    open_ = F.col("word").isNull() if "word" in matches.columns else F.size("candidates") > 1
    status = F.when(F.col("rank") > 1, "blocked").when(open_, "abstain").otherwise("winner")
    rows = ranked.select("track_id", "token_index", "rule_id", status.alias("status"), F.when(F.col("rank") > 1, F.col("winner")).alias("blocked_by"))
    return slots.select("track_id", "token_index").join(rows, ["track_id", "token_index"], "left").withColumn("status", F.coalesce("status", F.lit("none")))


def apply_fills(tracks: DataFrame, fills: DataFrame, text: str = "text", overrides: DataFrame | None = None, prefer_rules: bool = False, ambiguous: bool = True) -> DataFrame:
    """Texts with the marker of each filled slot replaced. fills, overrides: track_id, token_index, word. An override
    goes before a rule's fill, or after it with ``prefer_rules``; empty overrides count as none. Without ``ambiguous``,
    fills that had several candidates (a column of fills) are left out."""
    own = fills if ambiguous else fills.where(F.size("candidates") <= 1)
    own = own.where("word IS NOT NULL").select("track_id", "token_index", "word")
    if overrides is not None:
        other = overrides.where("word <> ''").select("track_id", "token_index", "word", F.lit(0 if prefer_rules else 2).alias("place"))
        both = own.withColumn("place", F.lit(1)).unionByName(other)
        own = both.groupBy("track_id", "token_index").agg(F.max_by("word", F.struct("place", "word")).alias("word"))
    words = own.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("token_index", "word"))).alias("fills"))
    parts = F.split(text, r"\[__\]", -1)
    joined = tracks.join(words, "track_id", "left")
    filled = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.try_element_at("fills", i - 1), F.lit("[__]")), p))), "")
    return joined.withColumn(text, filled).drop("fills")


def diff_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Template, change: added, removed, candidates or order (relative to the common templates)."""
    common = old.select("template").join(new.select("template"), "template")
    rank = lambda df, name: numbered(df.join(common, "template", "left_semi").select("template", "ord"), "ord", "template", name=name).drop("ord")
    both = old.select("template", F.col("candidates").alias("old_c"), F.lit(1).alias("o")).join(new.select("template", F.col("candidates").alias("new_c"), F.lit(1).alias("w")), "template", "full_outer")
    both = both.join(rank(old, "old_rank"), "template", "left").join(rank(new, "new_rank"), "template", "left")
    change = F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").when(F.col("old_c") != F.col("new_c"), "candidates").when(F.col("old_rank") != F.col("new_rank"), "order")
    return both.select("template", change.alias("change")).where("change IS NOT NULL")


def affected_tracks(matches: DataFrame, changed: DataFrame) -> DataFrame:
    """Tracks where a changed rule can match."""
    return matches.join(changed.select("rule_id"), "rule_id", "left_semi").select("track_id").distinct()


def estimate_priors(labelled: DataFrame) -> DataFrame:
    """By rule_id the most frequent expected word, its share, the margin to the next and the support."""
    counts = labelled.groupBy("rule_id", "expected").agg(F.count("*").alias("n"))
    w = Window.partitionBy("rule_id").orderBy(F.desc("n"), "expected")
    ranked = counts.withColumn("support", F.sum("n").over(Window.partitionBy("rule_id"))).withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("n").over(w), F.lit(0)))
    top = ranked.where("rank = 1")
    return top.select("rule_id", F.col("expected").alias("word"), (F.col("n") / F.col("support")).alias("p"), ((F.col("n") - F.col("second")) / F.col("support")).alias("margin"), "support")


def context_fallback(decided: DataFrame, local: DataFrame) -> DataFrame:
    """Slots still without a word take the one of their own context, if just one rule offers it.
    decided: all slots with a nullable word; local: track_id, token_index, word of matches in the slot's context."""
    one = local.groupBy("track_id", "token_index").agg(F.count_distinct("word").alias("words"), F.min("word").alias("local_word")).where("words = 1")
    joined = decided.join(one.drop("words"), ["track_id", "token_index"], "left")
    return joined.withColumn("word", F.coalesce("word", "local_word")).drop("local_word")


def rule_inventory(*parts: DataFrame) -> DataFrame:
    """All rules of several tables, one a rule_id (the first by tier and ord)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("rule_id").orderBy(tier_rank("tier"), F.col("ord").asc_nulls_last())
    return whole.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def pattern_match(contexts: DataFrame, pattern: str, context: str = "context") -> DataFrame:
    """Whether one template matches each context, at any marker; words and what stands between them are compared. The
    bracket is the marker, ``*`` any word but a marker; spaces match white space, commas and quotes."""
    head, _, tail = pattern.partition("[")

    def literal(text: str) -> str:
        one = {" ": T.SOFT_GAP, "'": "['’]", "*": r"(?:(?!\[__\])\S)+"}
        return "".join(one.get(c) or (c if c.isalnum() or c == "_" else "\\" + c) for c in text)

    template = literal(head) + r"\[__\]" + literal(tail.partition("]")[2])
    hit = T.normalize_mask(context).rlike(rf"(?iu)(?:^|{T.SIDE}){template}(?=$|{T.SIDE})")
    return contexts.withColumn("matched", F.coalesce(hit, F.lit(False)))
