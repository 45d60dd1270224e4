"""Alignment of masked tracks with unmasked ones.

Masked events, unmasked events: track_id, event_index, start_ms, dur_ms, text. Occurrences: track_id, occ_index, word,
start_ms, end_ms of lexicon words in the unmasked track. Interval joins meet in buckets of the drift's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.text import MARK, lexical_words
from slotloom.operators.chains import align_drifts
from slotloom.operators.rules import meet_anchors, verify_match, with_anchor
from slotloom.operators.slots import lexicon_pattern, unit_ms
from slotloom.sources.scratch import cut


def align_direct(masked: DataFrame, plain: DataFrame) -> DataFrame:
    """Events of equal place, start and duration; hidden text is what stands between the visible pieces. One word:
    known; several: ambiguous; pieces that do not fit: unknown."""
    same = ["track_id", "event_index", "start_ms", "dur_ms"]
    joined = masked.select(*same, F.split("text", r"\[__\]", -1).alias("pieces")).where(F.size("pieces") > 1).join(plain.select(*same, F.col("text").alias("full")), same)
    start = F.struct(F.when(F.startswith(F.col("full"), F.get("pieces", F.lit(0))), F.substring(F.col("full"), F.length(F.get("pieces", F.lit(0))) + 1, F.length("full"))).alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        at = F.when(piece == "", F.length(a["rest"]) + 1).otherwise(F.position(piece, a["rest"]))
        ok = a["rest"].isNotNull() & (at > 0)
        gap = F.when(ok, F.substring(a["rest"], F.lit(1), at - 1))
        rest = F.when(ok, F.substring(a["rest"], at + F.length(piece), F.length(a["rest"])))
        return F.struct(rest.alias("rest"), F.concat(a["out"], F.array(gap)).alias("out"))

    fold = F.aggregate(F.slice("pieces", 2, F.size("pieces") - 1), start, step)
    rows = joined.select("track_id", "event_index", F.posexplode(fold["out"]).alias("slot_in_event", "hidden"))
    words = lexical_words(F.coalesce("hidden", F.lit("")))
    status = F.when(F.size(words) == 1, "known").when(F.size(words) > 1, "ambiguous").otherwise("unknown")
    return rows.select("track_id", "event_index", "slot_in_event", F.lower(F.trim("hidden")).alias("expected"), status.alias("status"))


def _buckets(at: Column, until: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(at / width).cast("bigint"), F.floor(until / width).cast("bigint")))


def has_timed_ground_truth(masked: DataFrame, occurrences: DataFrame, drift_ms: int = 1500) -> DataFrame:
    """Tracks with a masked event within the drift of an occurrence."""
    width = 4 * drift_ms
    left = masked.where(F.col("text").contains(MARK)).select("track_id", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"))
    left = left.select("*", _buckets(F.col("start_ms") - drift_ms, F.col("end_ms") + drift_ms, width).alias("bucket"))
    right = occurrences.select("track_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).select("*", _buckets(F.col("s"), F.col("e"), width).alias("bucket"))
    near = (F.col("s") <= F.col("end_ms") + drift_ms) & (F.col("e") >= F.col("start_ms") - drift_ms)
    return left.join(right, ["track_id", "bucket"]).where(near).select("track_id").distinct()


def has_direct_ground_truth(masked: DataFrame, plain: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tracks whose events have the same places and times in both versions and whose every slot hides a word of the
    lexicon (E1)."""
    same = ["track_id", "event_index", "start_ms", "dur_ms"]
    tell = lambda df, side: df.select(*same, F.lit(1).alias(side))
    apart = tell(masked, "a").join(tell(plain, "b"), same, "full_outer").where("a IS NULL OR b IS NULL").select("track_id").distinct()
    found = F.coalesce(F.col("expected").rlike(lexicon_pattern(lexicon)), F.lit(False))
    slots = align_direct(masked, plain).groupBy("track_id").agg(F.bool_and(found).alias("whole"))
    return slots.where("whole").select("track_id").join(apart, "track_id", "left_anti")


def align_time(slots: DataFrame, occurrences: DataFrame, drift_ms: int) -> DataFrame:
    """Monotone assignment of slots (track_id, token_index, time_ms) to occurrences within the drift."""
    return align_drifts(slots, occurrences, (drift_ms,)).drop("drift")


def align_time_stable(slots: DataFrame, occurrences: DataFrame, drifts: tuple[int, ...] = (1500, 2000, 3000)) -> DataFrame:
    """Slots that get the same word at every drift; the occurrence is that of the first."""
    parts = align_drifts(slots, occurrences, drifts)
    first = F.max(F.when(F.col("drift") == drifts[0], F.col("occ_index"))).alias("occ_index")
    return parts.groupBy("track_id", "token_index").agg(F.count("*").alias("n"), F.count_distinct("word").alias("words"), F.min("word").alias("word"), first).where((F.col("n") == len(drifts)) & (F.col("words") == 1)).select("track_id", "token_index", "occ_index", "word")


def _agree(a: str, b: str) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, False).cast("int")
    return F.when(other == 0, F.size(same)).otherwise(other - 1)


def common_subsequence(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two arrays: one row of lengths per element of ``a``."""
    places = F.sequence(F.lit(1), F.size(b))

    def step(row: Column, x: Column) -> Column:
        longer = lambda out, j: F.when(x == F.element_at(F.col(b), j), F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(out, -1)))
        return F.aggregate(places, F.array(F.lit(0)), lambda out, j: F.concat(out, F.array(longer(out, j))))

    length = F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), step), -1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(length)


def _near(slots: DataFrame, tokens: DataFrame, around_ms: int, keyed: bool) -> DataFrame:
    """Slots with the words around their time, agreeing neighbours counted from the slot outwards: those with the same words
    next to them (``keyed``), or all. ``base`` is the score without common subsequences, ``most`` a bound of what those
    add."""
    buckets = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("time_ms") / around_ms) + i)).alias("bucket")
    kept = [c for c in ("top", "best") if c in slots.columns]
    left = slots.select("track_id", "token_index", "time_ms", F.col("lefts").alias("sl"), F.col("rights").alias("sr"), *kept)
    right = tokens.select("track_id", "occ_index", F.col("time_ms").alias("ot"), "word", "lefts", "rights", F.floor(F.col("time_ms") / around_ms).alias("bucket"))
    on = ["track_id", "bucket"]
    if keyed:
        ends = lambda df, a, b: df.select("*", F.get(a, F.lit(0)).alias("before"), F.get(b, F.lit(0)).alias("after"))
        left, right, on = ends(left, "sl", "sr"), ends(right, "lefts", "rights"), [*on, "before", "after"]
    far = F.abs(F.col("time_ms") - F.col("ot"))
    pairs = left.select("*", buckets).join(right, on).where(far <= around_ms)
    return _based(pairs, far)


def _based(pairs: DataFrame, far: Column) -> DataFrame:
    exact = pairs.withColumn("xl", _agree("sl", "lefts")).withColumn("xr", _agree("sr", "rights"))
    base = 5 * (F.col("xl") + F.col("xr")) + F.when((F.col("xl") > 0) & (F.col("xr") > 0), 3).otherwise(0) - 0.05 * far / 1000.0
    held = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(F.col(b), x)))
    return exact.withColumn("base", base).withColumn("most", held("sl", "lefts") + held("sr", "rights"))


def _scored(pairs: DataFrame) -> Column:
    return F.col("base") + common_subsequence("sl", "lefts") + common_subsequence("sr", "rights")


#: Slots of a track up to which its lines meet them in place.
SLOTS = 4096


def wide_lines(lines: DataFrame, reach: int) -> DataFrame:
    """Lines (``spoken_lines``) with ``around``: their lower-case units between up to ``reach`` ones of the track before and
    after, and ``skip``, how many stand before."""
    low = lines.select("*", F.explode(F.array(F.transform("units", F.lower))).alias("low"))
    order = Window.partitionBy("track_id").orderBy("event_index")
    last = lambda c: F.slice(c, F.greatest(F.size(c) - reach, F.lit(0)) + 1, reach)
    rows = low.withColumn("ahead", F.slice("low", 1, reach)).withColumn("tail", last("low"))
    rows = rows.withColumn("before", F.flatten(F.collect_list("tail").over(order.rowsBetween(-reach, -1)))).withColumn("after", F.flatten(F.collect_list("ahead").over(order.rowsBetween(1, reach))))
    rows = rows.withColumn("before", last("before"))
    around = F.concat("before", "low", F.slice("after", 1, reach))
    return rows.select("track_id", "start_ms", "dur_ms", "units", "first", F.size("before").alias("skip"), F.explode(F.array(around)).alias("around"))


def _unit(k: Column) -> Column:
    return F.get("around", F.col("skip") + k)


def sided(lines: DataFrame, places: Column, reach: int) -> DataFrame:
    """The units at ``places`` (an array) of ``wide_lines``: track_id, position, time_ms, unit, lefts, rights (nearest
    first)."""
    at = F.col("skip") + F.col("k")
    lefts = F.reverse(F.slice("around", F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach))))
    rows = lines.select("*", F.explode(places).alias("k"))
    return rows.select("track_id", (F.col("first") + F.col("k")).cast("bigint").alias("position"), unit_ms("k").alias("time_ms"), _unit(F.col("k")).alias("unit"), lefts.alias("lefts"), F.slice("around", at + 2, reach).alias("rights"))


def _few(rows: DataFrame, value: Column, most: int) -> DataFrame:
    """track_id, many (whether it has over ``most`` rows) and held: the values of its rows, none if many."""
    sized = rows.select("track_id", value.alias("v"), (F.count("*").over(Window.partitionBy("track_id")) > most).alias("many"))
    return sized.groupBy("track_id", "many").agg(F.collect_list(F.when(~F.col("many"), F.col("v"))).alias("held"))


def likely_tokens(lines: DataFrame, slots: DataFrame, reach: int = 15, most: int = SLOTS) -> DataFrame:
    """``sided`` units of the lines that have the same two words next to them as a slot (lefts, rights) of their track; all
    others are equal to no slot in E4's keys and E6's. Lines meet the slots of their track in place, so only these units are
    ever dealt out with their neighbours. Tracks of over ``most`` slots give all their units."""
    able = slots.where((F.size("lefts") > 0) & (F.size("rights") > 0))
    held = _few(able, F.xxhash64(F.get("lefts", F.lit(0)), F.get("rights", F.lit(0))), most)
    places = F.sequence(F.lit(0), F.size("units") - 1)
    met = wide_lines(lines, reach).join(held, "track_id")
    ends = F.transform(places, lambda k: F.xxhash64(_unit(k - 1), _unit(k + 1)))
    keyed = met.select("*", F.explode(F.array(ends)).alias("ends"))
    keyed = keyed.select("*", F.explode(F.array(F.array_intersect("ends", "held"))).alias("both")).where(F.col("many") | (F.size("both") > 0))
    hits = F.filter(places, lambda k: F.col("many") | F.array_contains("both", F.get("ends", k)))
    return sided(keyed, hits, reach)


def _rivals(low: DataFrame, lines: DataFrame, around_ms: int, margin: float, most: int = SLOTS // 4) -> DataFrame:
    """The pairs of ``_near`` for slots (with ``best``) and all units of their time that agree on one side at most and may
    still come within the margin. Lines meet the slots of their track in place; tracks of over ``most`` such slots are left
    to a join by time."""
    cols = ["token_index", "time_ms", "lefts", "rights", "best"]
    held = cut(_few(low, F.struct(*cols), most), "context-rivals")
    wide = wide_lines(lines, 15).join(held, "track_id")
    n = F.size("units")
    one, other = unit_ms(F.lit(0)), unit_ms(n - 1)
    timed = wide.where("NOT many").select("*", F.least(one, other).alias("from"), F.greatest(one, other).alias("to"))
    asked = timed.select("*", F.explode(F.filter("held", lambda s: (s["time_ms"] >= F.col("from") - around_ms) & (s["time_ms"] <= F.col("to") + around_ms))).alias("s")).drop("held")

    def may(k: Column) -> Column:
        near = F.abs(F.col("s.time_ms") - unit_ms(k)) <= around_ms
        left, right = F.coalesce(_unit(k - 1) == F.get("s.lefts", F.lit(0)), F.lit(False)), F.coalesce(_unit(k + 1) == F.get("s.rights", F.lit(0)), F.lit(False))
        # without a shared neighbour only subsequences count, one for each word of the slot at most
        return near & ~(left & right) & (left | right | (F.col("s.best") - F.size("s.lefts") - F.size("s.rights") < margin))

    pairs = asked.select("track_id", "start_ms", "dur_ms", "units", "skip", "first", "around", "s", F.explode(F.filter(F.sequence(F.lit(0), n - 1), may)).alias("k"))
    at = F.col("skip") + F.col("k")
    lefts = F.reverse(F.slice("around", F.greatest(at - 15, F.lit(0)) + 1, F.least(at, F.lit(15))))
    found = pairs.select("track_id", "s.token_index", F.col("s.lefts").alias("sl"), F.col("s.rights").alias("sr"), "s.best", F.abs(F.col("s.time_ms") - unit_ms("k")).alias("far"), lefts.alias("lefts"), F.slice("around", at + 2, 15).alias("rights"))
    few = _based(found, F.col("far")).drop("far")
    crowded = held.where("many").select("track_id")
    if crowded.isEmpty():
        return few
    tokens = sided(wide.where("many"), F.sequence(F.lit(0), n - 1), 15).select("track_id", F.col("position").alias("occ_index"), "time_ms", F.lit(None).cast("string").alias("word"), "lefts", "rights")
    return few.unionByName(_near(low.join(crowded, "track_id", "left_semi"), tokens, around_ms, False).select(few.columns))


def align_context(slots: DataFrame, tokens: DataFrame, margin: float = 3.0, around_ms: int = 10_000, lines: DataFrame | None = None) -> DataFrame:
    """The best candidate within ``around_ms``, if it has a label, leads by the margin and agrees on both sides. slots:
    track_id, token_index, time_ms, lefts, rights (nearest first); tokens: track_id, occ_index, time_ms, word (null: no
    label), lefts, rights.

    A winner agrees with both words next to the slot, so slots and tokens meet on these and the track, not on time alone. Any
    other word agrees on one side at most, which bounds its score by the slot's words: only slots whose winner does not
    lead that bound by the margin meet all words of their time. Subsequences are made for pairs that can still come within
    the margin of the best."""
    slot = Window.partitionBy("track_id", "token_index")
    able = slots.where((F.size("lefts") > 0) & (F.size("rights") > 0))
    near = _near(able, tokens, around_ms, True)
    near = near.withColumn("top", F.max("base").over(slot)).where(F.col("base") + F.col("most") >= F.col("top") - margin)
    w = slot.orderBy(F.desc("score"), "occ_index")
    ranked = near.withColumn("score", _scored(near)).withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    won = ranked.where("k = 1 AND word IS NOT NULL").where(F.col("second").isNull() | (F.col("score") - F.col("second") >= margin))
    won = won.select("track_id", "token_index", "time_ms", "sl", "sr", "occ_index", "word", "score")
    if lines is not None:
        won = cut(won, "context-winners")
    low = won.where(F.col("score") - margin < 5 * F.greatest(F.size("sl"), F.size("sr")) + F.size("sl") + F.size("sr"))
    low = low.select("track_id", "token_index", "time_ms", F.col("sl").alias("lefts"), F.col("sr").alias("rights"), F.col("score").alias("best"))
    rest = _near(low, tokens, around_ms, False) if lines is None else _rivals(low, lines, around_ms, margin)
    rest = rest.where("xl = 0 OR xr = 0").where(F.col("best") - F.col("base") - F.col("most") < margin)
    beaten = rest.where(F.col("best") - _scored(rest) < margin).select("track_id", "token_index").distinct()
    return won.join(beaten, ["track_id", "token_index"], "left_anti").select("track_id", "token_index", "occ_index", "word", "score")


def merge_alignments(by_context: DataFrame, by_time: DataFrame, fixed: DataFrame) -> DataFrame:
    """E5: fixed labels stand; context proposals, best score first, take their occurrence; time matches get what is left.
    Each occurrence is used once."""
    context = by_context.join(fixed, ["track_id", "token_index"], "left_anti")
    w = Window.partitionBy("track_id", "occ_index").orderBy(F.desc("score"), "token_index")
    taken = context.withColumn("k", F.row_number().over(w)).where("k = 1").select("track_id", "token_index", "occ_index", "word", F.lit("context").alias("source"))
    free = by_time.join(fixed, ["track_id", "token_index"], "left_anti").join(taken, ["track_id", "token_index"], "left_anti").join(taken, ["track_id", "occ_index"], "left_anti")
    pinned = fixed.select("track_id", "token_index", F.lit(None).cast("bigint").alias("occ_index"), "word", F.lit("fixed").alias("source"))
    return taken.unionByName(free.select("track_id", "token_index", "occ_index", "word", F.lit("time").alias("source"))).unionByName(pinned)


def track_offset(slots: DataFrame, tokens: DataFrame, near_ms: int = 2000, least: int = 3, exact: int = 6) -> DataFrame:
    """The median time difference of a track's largest cluster of slots and their tokens, if it holds at least three and
    half of them. A slot's token agrees with it in ``exact`` words or more counted outwards, on both sides, and in more than
    any other. slots: track_id, token_index, time_ms, lefts, rights (nearest first); tokens: track_id, occ_index, time_ms,
    lefts, rights. Pairs meet on the words that one of the sides must share, so frequent neighbours alone pair nothing."""
    deep = (exact + 1) // 2

    def keys(side: str) -> Column:
        one = lambda c, tag: F.when(F.size(c) >= deep, F.concat_ws("\u0000", F.lit(tag), F.slice(c, 1, deep)))
        return F.explode(F.filter(F.array(one(f"{side}lefts", "l"), one(f"{side}rights", "r")), lambda k: k.isNotNull())).alias("key")

    ends = lambda side: [F.get(f"{side}lefts", F.lit(0)).alias("left"), F.get(f"{side}rights", F.lit(0)).alias("right")]
    a = slots.select("track_id", "token_index", F.col("time_ms").alias("st"), F.col("lefts").alias("slefts"), F.col("rights").alias("srights"))
    pairs = a.select("*", *ends("s"), keys("s")).join(tokens.select("track_id", "occ_index", F.col("time_ms").alias("tt"), "lefts", "rights", *ends(""), keys("")), ["track_id", "left", "right", "key"])
    counted = pairs.withColumn("exact", _agree("slefts", "lefts") + _agree("srights", "rights")).where(F.col("exact") >= exact)
    each = counted.select("track_id", "token_index", "occ_index", "exact", (F.col("tt") - F.col("st")).alias("delta")).dropDuplicates(["track_id", "token_index", "occ_index"])
    slot = Window.partitionBy("track_id", "token_index").orderBy(F.desc("exact"))
    best = each.withColumn("k", F.row_number().over(slot)).withColumn("second", F.lead("exact").over(slot)).where("k = 1 AND (second IS NULL OR second < exact)").select("track_id", "delta")
    w = Window.partitionBy("track_id").orderBy("delta").rangeBetween(-near_ms, near_ms)
    sized = best.withColumn("size", F.count("*").over(w)).withColumn("all", F.count("*").over(Window.partitionBy("track_id")))
    # The cluster's centre is kept beside the differences, so they are found only once.
    first = F.max(F.struct("size", (-F.abs("delta")).alias("m"), "delta")).over(Window.partitionBy("track_id"))
    good = sized.withColumn("c", first).where((F.col("c.size") >= least) & (2 * F.col("c.size") >= F.col("all")) & (F.abs(F.col("delta") - F.col("c.delta")) <= near_ms))
    return good.groupBy("track_id").agg(F.percentile("delta", F.lit(0.5)).alias("offset_ms"), F.count("*").alias("pairs"))


def align_shifted(slots: DataFrame, occurrences: DataFrame, offsets: DataFrame, known: DataFrame, drift_ms: int = 1500) -> DataFrame:
    """On tracks shifted by over a second, time matches after the shift for slots and occurrences still free."""
    moved = slots.join(offsets.where(F.abs("offset_ms") > 1000).select("track_id", "offset_ms"), "track_id").withColumn("time_ms", (F.col("time_ms") + F.col("offset_ms")).cast("bigint")).drop("offset_ms")
    found = align_time(moved, occurrences, drift_ms)
    return found.join(known, ["track_id", "token_index"], "left_anti").join(known, ["track_id", "occ_index"], "left_anti")


def override_labels(aligned: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual labels replace aligned ones."""
    joined = aligned.join(manual.select("track_id", "token_index", F.col("word").alias("manual_word")), ["track_id", "token_index"], "full_outer")
    return joined.select("track_id", "token_index", F.coalesce("manual_word", "word").alias("word"))


def unaligned(slots: DataFrame, aligned: DataFrame) -> DataFrame:
    """Slots without label."""
    return slots.join(aligned.where("word IS NOT NULL"), ["track_id", "token_index"], "left_anti")


def restrict_labels(labels: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Labels inside the allowed vocabulary."""
    return labels.join(lexicon.select("word"), "word", "left_semi")


def unpaired(tracks: DataFrame, least: int) -> DataFrame:
    """Masked tracks without a partner and with more slots than ``least``, one version an id.
    tracks: track_id, side, version, slots."""
    w = Window.partitionBy("track_id").orderBy(F.desc("slots"), "version")
    alone = tracks.where("side = 'auto'").join(tracks.where("side = 'manual'"), "track_id", "left_anti")
    return alone.where(F.col("slots") > least).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def _fits() -> Column:
    """Of a row with a phrase's ``words`` and an event's ``line`` and ``slots``: where the phrase may start (at), counted from
    the event's first word, so that all its words that come to stand in the event are met there; with the number of these
    (covered), whether one is met as a literal word (anchored), and the slots under its markers (tokens)."""
    n, m = F.size("words"), F.size("line")
    word, shown = (lambda i: F.get("words", i)), (lambda i: F.get("line", i))
    slot = lambda i: F.get(F.filter("slots", lambda x: x["at"] == i), F.lit(0))
    meets = lambda i, j: F.coalesce((shown(j) == word(i)) | ((shown(j) == MARK) & (slot(j)["resolved"] == word(i))), F.lit(False))
    first = lambda s: F.greatest(F.lit(0), -s)
    inside = lambda s: F.sequence(first(s), F.least(n, m - s) - 1)
    starts = F.filter(F.sequence(1 - n, m - 1), lambda s: meets(first(s), s + first(s)) & F.forall(inside(s), lambda i: meets(i, s + i)))

    def fit(s: Column) -> Column:
        same = F.filter(inside(s), lambda i: shown(s + i) == word(i))
        tokens = F.transform(F.filter(same, lambda i: word(i) == MARK), lambda i: slot(s + i)["token_index"])
        return F.struct(s.alias("at"), F.size(inside(s)).alias("covered"), F.exists(same, lambda i: word(i) != MARK).alias("anchored"), F.filter(tokens, lambda x: x.isNotNull()).alias("tokens"))

    return F.when(m > 0, F.transform(starts, fit))


def locate_phrase(phrases: DataFrame, timeline: DataFrame, events: int = 4, reach_s: float = 15.0) -> DataFrame:
    """The slots that a displayed phrase shows. phrases: phrase_id, track_id, words, at_s (the playhead); timeline:
    track_id, event_index, start_s, end_s, words: array of (word, token_index, resolved), the last two of slots only. The
    phrase is looked for in the events within ``reach_s`` seconds and ``events`` places of the one nearest the playhead. A
    slot is met by a marker or by its resolved word. Only one way to map the phrase's markers, with a literal word, counts.
    An event's words stay where they meet its phrases; only the places where a phrase may stand go on, and a phrase that
    runs over several events is put together from those."""
    width = 2 * reach_s
    bucket = lambda x: F.floor(x / width).cast("bigint")
    span = lambda a, b: F.explode(F.sequence(bucket(a), bucket(b))).alias("bucket")
    order = Window.partitionBy("track_id").orderBy("start_s", "event_index")
    line = F.coalesce(F.transform("words", lambda t: t["word"]), F.array().cast("array<string>"))
    slots = F.filter(F.transform("words", lambda t, i: F.when(t["word"] == MARK, F.struct(i.alias("at"), t["token_index"].alias("token_index"), t["resolved"].alias("resolved")))), lambda x: x.isNotNull())
    start, end, at = F.col("start_s"), F.col("end_s"), F.col("at_s")
    placed = timeline.select("track_id", "event_index", "start_s", "end_s", line.alias("line"), slots.alias("slots")).withColumn("place", F.row_number().over(order)).drop("event_index").select("*", span(start, end))
    asked = phrases.select("phrase_id", "track_id", "words", "at_s").where(F.col("track_id").isNotNull() & F.exists("words", lambda w: w == MARK)).dropDuplicates(["phrase_id"]).select("*", span(at - reach_s, at + reach_s))
    once = F.col("bucket") == F.greatest(bucket(F.least(start, end)), bucket(at - reach_s))  # of the buckets that both are in
    met = placed.join(asked, ["track_id", "bucket"]).where((end >= at - reach_s) & (start <= at + reach_s) & once)
    far = F.greatest(start - at, at - end, F.lit(0.0))
    near = met.select("phrase_id", F.size("words").alias("n"), "place", far.alias("far"), F.size("line").alias("m"), _fits().alias("fits"))
    of_phrase = Window.partitionBy("phrase_id").orderBy("place")
    nearest = F.min(F.struct("far", "place")).over(of_phrase.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["place"]
    kept = near.withColumn("nearest", nearest).where(F.abs(F.col("place") - F.col("nearest")) <= events)
    before = F.coalesce(F.sum("m").over(of_phrase.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kept.withColumn("before", before).select("phrase_id", "n", "place", "before", F.explode("fits").alias("fit"))
    tokens = F.sort_array(F.collect_list(F.struct("place", "fit.tokens")))
    whole = parts.groupBy("phrase_id", "n", (F.col("before") + F.col("fit.at")).alias("start")).agg(F.sum("fit.covered").alias("covered"), F.max("fit.anchored").alias("anchored"), tokens.alias("held")).where("covered = n AND anchored")
    maps = whole.select("phrase_id", F.flatten(F.transform("held", lambda h: h["tokens"])).alias("map")).where(F.size("map") > 0)
    return maps.groupBy("phrase_id").agg(F.min("map").alias("token_indexes"), F.max("map").alias("other")).where("token_indexes = other").drop("other")


def covers(windows: DataFrame, segments: DataFrame, tolerance_ms: int = 0, width_ms: int = 60_000) -> DataFrame:
    """Whether each window (track_id, window_id, start_ms, end_ms; the end clamped to the last segment's) lies in one
    segment."""
    last = segments.groupBy("track_id").agg(F.max("end_ms").alias("limit_ms"))
    wins = windows.join(last, "track_id", "left").withColumn("until", F.least("end_ms", F.coalesce("limit_ms", "end_ms")))
    left = wins.withColumn("bucket", F.floor(F.col("start_ms") / width_ms).cast("bigint"))
    right = segments.select("track_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")).select("*", _buckets(F.col("s") - tolerance_ms, F.col("e") + tolerance_ms, width_ms).alias("bucket"))
    held = left.join(right, ["track_id", "bucket"]).where((F.col("s") - tolerance_ms <= F.col("start_ms")) & (F.col("e") + tolerance_ms >= F.col("until"))).select("track_id", "window_id").distinct().withColumn("covered", F.lit(True))
    return windows.join(held, ["track_id", "window_id"], "left").select("track_id", "window_id", F.coalesce("covered", F.lit(False)).alias("covered"))


def attach_provenance(slots: DataFrame, provenance: DataFrame) -> DataFrame:
    """Class, creator and eligibility of each slot's track."""
    return slots.join(provenance, "track_id", "left")


def lead_evidence(leads: DataFrame, features: DataFrame) -> DataFrame:
    """(lead, row_id) where a row meets all conditions of a lead. leads: lead, conditions; features: row_id, off, tok.
    A lead meets rows on its rarest condition, the others are verified there: one that many leads and rows share pairs
    nothing."""
    anchored = with_anchor(leads.select(F.col("lead").alias("rule_id"), "conditions"), features.groupBy("off", "tok").agg(F.count("*").alias("n")))
    rows = features.groupBy("row_id").agg(F.collect_set(F.struct("off", "tok")).alias("around"))
    keyed = rows.select("row_id", "around", F.explode("around").alias("f")).select("row_id", "around", F.col("f.off").alias("anchor_off"), F.col("f.tok").alias("anchor_tok"))
    return meet_anchors(keyed, anchored).where(verify_match("conditions", "around")).select(F.col("rule_id").alias("lead"), "row_id")
