"""Slots, time and context. Tables have a ``track_id``; every window is within a track."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions import text as T

MAX_LEXICON = 20_000


def lexicon_pattern(lexicon: DataFrame, word: str = "word") -> str:
    """A pattern of all words, longest first. The lexicon is a bounded table; its size is checked."""
    words = [r[0] for r in lexicon.select(word).distinct().limit(MAX_LEXICON + 1).collect() if r[0]]
    if len(words) > MAX_LEXICON:
        raise ValueError("the lexicon is too large for a pattern; join tokens with it instead")
    escaped = sorted(words, key=lambda w: (-len(w), w))
    return r"(?i)\b(" + "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in escaped) + r")\b"


def mask_lexicon(tracks: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """C11: the tracks with lexicon words replaced by the marker, ``slots`` counted, only those with a slot."""
    masked = F.regexp_replace("original", lexicon_pattern(lexicon), T.MARK)
    # explode over one element: the pattern runs once a text, not anew for each later use of the masked text
    rows = tracks.withColumnRenamed(text, "original").select("*", F.explode(F.array(masked)).alias(text))
    return rows.withColumn("slots", T.count_mask(text)).where("slots > 0")


def line_events(tracks: DataFrame, text: str = "text", ms_per_word: int = 300) -> DataFrame:
    """Lines of a text as timed events: track_id, event_index, start_ms, dur_ms, text (and ``original`` if there)."""
    lines = F.split(text, "\n")
    cols = [c for c in ("creator", "pair_class") if c in tracks.columns]
    rows = tracks.select("track_id", *cols, F.posexplode(lines).alias("event_index", "text"))
    rows = rows.withColumn("units", T.spoken_units("text").cast("bigint"))
    before = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("track_id", *cols, "event_index", (F.coalesce(F.sum("units").over(before), F.lit(0)) * ms_per_word).alias("start_ms"), (F.col("units") * ms_per_word).alias("dur_ms"), "text")


def extract_slots(events: DataFrame) -> DataFrame:
    """One row a slot with track-wide token_index, slot_in_event and char_off; if events have segs, also
    seg_offset_ms, the time offset of the segment that holds the slot (null: untimed)."""
    timed = "segs" in events.columns
    segs = F.transform("segs", lambda s: F.struct(F.length(T.normalize_mask(F.coalesce(s["utf8"], F.lit("")))).alias("n"), s["tOffsetMs"].alias("ms"))) if timed else None
    text = T.normalize_mask("text")
    counted = events.select("track_id", "event_index", "start_ms", "dur_ms", text.alias("text"), *([segs.alias("segs")] if timed else [])).withColumn("n", T.count_mask("text"))
    before = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")
    gaps = placed.select("*", F.posexplode(F.split("text", r"\[__\]", -1)).alias("slot_in_event", "piece"))
    upto = Window.partitionBy("track_id", "event_index").orderBy("slot_in_event")
    gaps = gaps.withColumn("char_off", F.sum(F.length("piece")).over(upto) + 4 * F.col("slot_in_event"))
    offset = []
    if timed:
        first = F.struct(F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("ms"))
        step = lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.when((a["at"] <= F.col("char_off")) & (F.col("char_off") < a["at"] + s["n"]), s["ms"]).otherwise(a["ms"]).alias("ms"))
        offset = [F.aggregate("segs", first, step)["ms"].alias("seg_offset_ms")]
    return gaps.where("slot_in_event < n").select("track_id", (F.col("base") + F.col("slot_in_event")).cast("int").alias("token_index"), "event_index", "slot_in_event", F.col("char_off").cast("int").alias("char_off"), "start_ms", "dur_ms", "text", *offset)


def event_durations(events: DataFrame) -> DataFrame:
    """next_start_ms is the least of all later starts. An event without a duration ends there, and so does one of a
    fixed two-row page (column fixed_page) that lasts beyond it: such pages give the page's time for every event."""
    later = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(1, Window.unboundedFollowing)
    rows = events.withColumn("next_start_ms", F.min("start_ms").over(later))
    gap = F.col("next_start_ms") - F.col("start_ms")
    dur = F.coalesce("dur_ms", F.lit(0))
    page = F.coalesce("fixed_page", F.lit(False)) if "fixed_page" in events.columns else F.lit(False)
    return rows.withColumn("fixed_dur_ms", F.when(gap.isNotNull() & ((dur <= 0) | (page & (gap < dur))), gap).otherwise(dur))


def slot_times(slots: DataFrame) -> DataFrame:
    """Seconds of a slot: its segment's offset (seg_offset_ms) if there is one, else in proportion to the words and
    slots before it in its event."""
    head = F.substring(F.col("text"), F.lit(1), F.col("char_off"))
    units = F.greatest(T.spoken_units("text"), F.lit(1))
    share = F.greatest("dur_ms", F.lit(0)) * T.spoken_units(head) / units
    ms = F.col("start_ms") + (F.coalesce("seg_offset_ms", share) if "seg_offset_ms" in slots.columns else share)
    return slots.withColumn("time_s", (ms / 1000.0).cast("double"))


def timeline(events: DataFrame, hold_ms: int = 5000) -> DataFrame:
    """C4: visible events with start and end in seconds; without a duration, to the next start or five seconds."""
    order = Window.partitionBy("track_id").orderBy("start_ms", "event_index")
    shown = events.where(F.trim("text") != "").withColumn("following", F.lead("start_ms").over(order))
    end = F.when(F.col("dur_ms") > 0, F.col("start_ms") + F.col("dur_ms")).otherwise(F.coalesce("following", F.col("start_ms") + hold_ms))
    return shown.select("track_id", "event_index", (F.col("start_ms") / 1000.0).alias("start_s"), (end / 1000.0).alias("end_s"), "text")


def event_context(events: DataFrame, before: int = 1, after: int = 0) -> DataFrame:
    """track_id, event_index, context (neighbouring visible events joined) and marks_before (the markers in those before)."""
    w = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(-before, after)
    prior = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(-before, -1)
    shown = events.where(F.trim("text") != "").withColumn("text", T.normalize_mask("text")).withColumn("marks", T.count_mask("text"))
    return shown.select("track_id", "event_index", F.array_join(F.collect_list("text").over(w), " ").alias("context"), (F.coalesce(F.sum("marks").over(prior), F.lit(0)) if before else F.lit(0)).alias("marks_before"))


def slot_context(slots: DataFrame, events: DataFrame, before: int = 1, after: int = 0) -> DataFrame:
    """Neighbouring visible events joined, and the slot's ordinal among the markers in them."""
    joined = slots.join(event_context(events, before, after), ["track_id", "event_index"])
    return joined.withColumn("slot_index", (F.col("marks_before") + F.col("slot_in_event")).cast("int")).drop("marks_before")


def slotted_contexts(slots: DataFrame, events: DataFrame, before: int = 1, after: int = 0) -> DataFrame:
    """The contexts of ``slot_context`` once an event that has a slot, not once a slot: track_id, event_index, context."""
    held = slots.select("track_id", "event_index").distinct()
    return event_context(events, before, after).drop("marks_before").join(held, ["track_id", "event_index"], "left_semi")


def filled_context(slots: DataFrame, events: DataFrame, fills: DataFrame, before: int = 1, after: int = 0, other: str = "…") -> DataFrame:
    """The slot's context with every other slot shown as its fill (track_id, token_index, word), or ``other``."""
    words = slots.select("track_id", "event_index", "token_index").join(fills.select("track_id", "token_index", "word"), ["track_id", "token_index"], "left")
    held = words.groupBy("track_id", "event_index").agg(F.sort_array(F.collect_list(F.struct("token_index", F.coalesce("word", F.lit(other)).alias("word")))).alias("fills"))
    shown = events.where(F.trim("text") != "").select("track_id", "event_index").join(held, ["track_id", "event_index"], "left")
    w = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(-before, after)
    none = F.array().cast("array<string>")
    near = shown.select("track_id", "event_index", F.flatten(F.collect_list(F.coalesce(F.transform("fills", lambda f: f["word"]), none)).over(w)).alias("around"))
    rows = slot_context(slots, events, before, after).join(near, ["track_id", "event_index"])
    parts = F.split("context", r"\[__\]", -1)
    place = F.col("slot_index") + 1
    pieces = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i == place, T.MARK).otherwise(F.get("around", i - 1)), p)))
    return rows.withColumn("context", F.array_join(pieces, "")).drop("around")


def only_target(context: Column | str, slot_index: Column | str, other: str = "…") -> Column:
    """A context in which just one slot keeps its marker."""
    parts = F.split(context, r"\[__\]", -1)
    index = F.col(slot_index) if isinstance(slot_index, str) else slot_index
    pieces = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i == index + 1, T.MARK).otherwise(other), p)))
    return F.array_join(pieces, "")


def spoken_lines(events: DataFrame) -> DataFrame:
    """Words and slots of every event that has any: track_id, event_index, start_ms, dur_ms, units, first (the position of
    the first one in the track). Positions come from a sum over events, words are never sorted."""
    units = F.regexp_extract_all(T.normalize_mask("text"), F.lit(T.UNIT), 1)
    # explode over one element: the units are found once an event, not anew for each of them
    held = events.select("track_id", "event_index", "start_ms", "dur_ms", F.explode(F.array(units)).alias("units"))
    before = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("first", F.coalesce(F.sum(F.size("units")).over(before), F.lit(0)).cast("int")).where(F.size("units") > 0)


def unit_s(k: Column | str) -> Column:
    """Seconds of unit ``k`` of a line."""
    at = F.col(k) if isinstance(k, str) else k
    return (F.col("start_ms") + F.col("dur_ms") * at / F.size("units")) / 1000.0


def unit_ms(k: Column | str) -> Column:
    return F.round(unit_s(k) * 1000).cast("bigint")


def spoken_words(events: DataFrame) -> DataFrame:
    """Words and slots of a track in order, with their times: track_id, position, unit, time_s."""
    rows = spoken_lines(events).select("*", F.posexplode("units").alias("k", "unit"))
    return rows.select("track_id", (F.col("first") + F.col("k")).alias("position"), "unit", unit_s("k").alias("time_s"))


def timed_units(events: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """The words and slots that ``wanted`` tells, with C3's times: track_id, position (of all in the track), number (of the
    wanted ones), unit, time_s. They are found once a line, and only they leave it: neither the line's text nor its words
    are copied to each of them, sorted or scanned again."""
    units = F.regexp_extract_all(T.normalize_mask("text"), F.lit(T.UNIT), 1)
    # explode over one element: the units are found once an event, not anew for each of them
    held = events.select("track_id", "event_index", "start_ms", "dur_ms", F.explode(F.array(units)).alias("units"))
    found = F.filter(F.transform("units", lambda u, i: F.when(wanted(u), F.struct(i.alias("k"), u.alias("unit")))), lambda x: x.isNotNull())
    lines = held.select("track_id", "event_index", "start_ms", "dur_ms", F.size("units").alias("n"), found.alias("found"))
    before = Window.partitionBy("track_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("base", F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)))
    rows = sums.where(F.size("found") > 0).select("track_id", "start_ms", "dur_ms", "n", "first", "base", F.posexplode("found").alias("i", "u"))
    time = (F.col("start_ms") + F.greatest("dur_ms", F.lit(0)) * F.col("u.k") / F.col("n")) / 1000.0
    return rows.select("track_id", (F.col("first") + F.col("u.k")).cast("bigint").alias("position"), (F.col("base") + F.col("i")).cast("bigint").alias("number"), F.col("u.unit").alias("unit"), time.alias("time_s"))


#: Units of a line that C8 counts in one piece.
PIECE = 256


def spoken_context(lines: DataFrame, back_s: int = 30, ahead_s: int = 2) -> DataFrame:
    """For each slot, how many words and slots stand in the seconds before, and the next word unless a slot is first.
    lines: those of ``spoken_lines``. Lines are cut into pieces of up to PIECE units within one bucket of time; slots meet
    the pieces of two buckets, and only pieces over an edge are looked into, so words never leave their line."""
    width = 1000 * back_s
    later = Window.partitionBy("track_id").orderBy("event_index")
    rows = lines.withColumn("next_unit", F.lead(F.get("units", F.lit(0))).over(later)).withColumn("next_ms", F.lead(unit_ms(F.lit(0))).over(later))
    places = F.filter(F.transform("units", lambda u, i: F.when(u == T.MARK, i)), lambda i: i.isNotNull())
    slots = rows.select("*", F.explode(places).alias("k"))
    nxt = F.coalesce(F.get("units", F.col("k") + 1), F.col("next_unit"))
    soon = F.when(F.col("k") + 1 < F.size("units"), unit_ms(F.col("k") + 1)).otherwise(F.col("next_ms")) - unit_ms("k") <= 1000 * ahead_s
    slots = slots.select("track_id", (F.col("first") + F.col("k")).alias("position"), unit_s("k").alias("time_s"), F.when(soon & (nxt != T.MARK), F.lower(nxt)).alias("next_word"), unit_ms("k").alias("t"))
    slots = slots.select("*", F.explode(F.array_distinct(F.array(F.floor(F.col("t") / width) - 1, F.floor(F.col("t") / width)))).alias("bucket"))

    bucket = lambda k: F.coalesce(F.floor(unit_ms(k) / width), F.lit(0))
    all_ = F.sequence(F.lit(0), F.size("units") - 1)
    heads = lines.select("track_id", "first", "start_ms", "dur_ms", "units", F.explode(F.array(F.filter(all_, lambda k: (k % PIECE == 0) | (bucket(k) != bucket(k - 1))))).alias("heads"))
    cut_ = heads.select("track_id", "first", "start_ms", "dur_ms", F.size("units").alias("n"), F.posexplode("heads").alias("i", "k0"), "heads", "units")
    k1 = F.coalesce(F.get("heads", F.col("i") + 1) - 1, F.size("units") - 1)
    cut_ = cut_.withColumn("k1", k1).withColumn("lo", F.least(unit_ms("k0"), unit_ms("k1"))).withColumn("hi", F.greatest(unit_ms("k0"), unit_ms("k1")))
    pieces = cut_.select("track_id", F.floor(F.col("lo") / width).alias("b"), (F.col("first") + F.col("k0")).alias("p0"), "start_ms", "dur_ms", "n", "k0", "k1", "lo", "hi")

    met = slots.join(pieces.withColumnRenamed("track_id", "__track"), (F.col("track_id") == F.col("__track")) & F.col("bucket").eqNullSafe(F.col("b")))
    ms = lambda k: F.round((F.col("start_ms") + F.col("dur_ms") * k / F.col("n")) / 1000.0 * 1000).cast("bigint")
    size, t = F.col("k1") - F.col("k0") + 1, F.col("t")
    inside = lambda k: (ms(k) >= t - width) & ((ms(k) < t) | ((ms(k) == t) & (F.col("p0") + k - F.col("k0") < F.col("position"))))
    count = (
        F.when(F.col("lo").eqNullSafe(t) & F.col("hi").eqNullSafe(t), F.greatest(F.least(F.col("position") - F.col("p0"), size), F.lit(0)))
        .when((F.col("hi") < t - width) | (F.col("lo") > t), 0).when((F.col("lo") >= t - width) & (F.col("hi") < t), size)
        .otherwise(F.size(F.filter(F.sequence("k0", "k1"), inside)))
    )
    return met.groupBy("track_id", "position", "time_s", "next_word").agg(F.sum(count).alias("preceding")).select("track_id", "position", "time_s", "preceding", "next_word")


def sentence_context(tracks: DataFrame, words: int = 4, most: int = 120, text: str = "text") -> DataFrame:
    """For each slot the union of its sentence and the words around it, if that is over ``most``
    characters (``fallback``) the words around it, and of these, if still over, ``most`` characters around the slot."""
    tokens = F.filter(F.split(T.normalize_mask(text), r"\s+"), lambda w: w != "")
    rows = tracks.select("track_id", F.explode(F.array(tokens)).alias("tokens"))
    ends = F.filter(F.transform("tokens", lambda w, i: F.when(w.rlike(r"[.!?][\"')]*$") & ~F.lower(w).rlike(r"^(mr|mrs|ms|dr|st|vs|etc|e\.g|i\.e)\.$"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("ends", ends).select("*", F.posexplode("tokens").alias("at", "token")).where(F.col("token").contains(T.MARK))
    first = F.coalesce(F.array_max(F.filter("ends", lambda e: e < F.col("at"))) + 1, F.lit(0))
    last = F.coalesce(F.array_min(F.filter("ends", lambda e: e >= F.col("at"))), F.size("tokens") - 1)
    lo, hi = F.greatest(F.least(first, F.col("at") - words), F.lit(0)), F.least(F.greatest(last, F.col("at") + words), F.size("tokens") - 1)
    full = F.array_join(F.slice("tokens", lo + 1, hi - lo + 1), " ")
    near_lo, near_hi = F.greatest(F.col("at") - words, F.lit(0)), F.least(F.col("at") + words, F.size("tokens") - 1)
    near = F.array_join(F.slice("tokens", near_lo + 1, near_hi - near_lo + 1), " ")
    ahead = F.array_join(F.slice("tokens", near_lo + 1, F.col("at") - near_lo), " ")
    middle = F.when(F.col("at") > near_lo, F.length(ahead) + 1).otherwise(0) + F.length("token") / 2
    first = F.greatest(F.least(F.floor(middle - most / 2), F.length(near) - most), F.lit(0))
    short = F.when(F.length(near) <= most, near).otherwise(F.substring(near, (first + 1).cast("int"), F.lit(most)))
    return rows.select("track_id", "at", F.when(F.length(full) <= most, full).otherwise(short).alias("context"), (F.length(full) > most).alias("fallback"))


def context_dim(contexts: DataFrame, context: str = "context") -> DataFrame:
    """Distinct contexts with id, shape and word count."""
    key = T.context_key(context)
    rows = contexts.select(T.stable_id("context", key).alias("context_id"), key.alias("text")).dropDuplicates(["context_id"])
    return rows.select("context_id", "text", T.context_shape("text").alias("shape"), F.size(F.split("text", " ")).alias("word_count"))


def speech_windows(slots: DataFrame, before: float = 3.0, after: float = 1.5, most: float = 30.0) -> DataFrame:
    """Slots packed greedily in time order; a window opens ``before`` seconds ahead of its first slot and takes a
    slot while its end stays within ``most`` seconds. Times are cut at gaps of over ``most`` seconds, where a window always
    ends; a fold finds the windows' first slots between two gaps and keeps those alone."""
    order = Window.partitionBy("track_id").orderBy("time_s", "token_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = slots.select("track_id", "token_index", "time_s")
    apart = F.coalesce(F.col("time_s") - F.lag("time_s").over(order) > most, F.lit(True))
    islands = rows.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(upto))
    times = islands.groupBy("track_id", "island").agg(F.sort_array(F.collect_list(F.struct("time_s", "token_index"))).alias("times"))
    kind = rows.schema["token_index"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("double").alias("opens"), F.array().cast(f"array<{kind}>").alias("firsts"))

    def step(a: Column, t: Column) -> Column:
        joins = F.coalesce(t["time_s"] + after <= a["opens"] + most, F.lit(False))
        return F.when(joins, a).otherwise(F.struct((t["time_s"] - before).alias("opens"), F.concat(a["firsts"], F.array(t["token_index"])).alias("firsts")))

    firsts = times.select("track_id", F.explode(F.aggregate("times", start, step)["firsts"]).alias("token_index")).withColumn("first", F.lit(1))
    marked = rows.join(firsts, ["track_id", "token_index"], "left")
    number = (F.sum(F.coalesce("first", F.lit(0))).over(upto) - 1).cast("int")
    opens = F.last(F.when(F.col("first") == 1, F.col("time_s") - before), ignorenulls=True).over(upto)
    return marked.select("track_id", "token_index", number.alias("window_no"), opens.alias("opens"))


def merge_intervals(slots: DataFrame, before: int = 35, after: int = 30) -> DataFrame:
    """Padded whole-second intervals, merged where they overlap."""
    padded = slots.select("track_id", F.greatest(F.floor(F.col("time_s") - before), F.lit(0)).cast("bigint").alias("a"), F.ceil(F.col("time_s") + after).cast("bigint").alias("b"))
    order = Window.partitionBy("track_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = padded.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    # Equal intervals are of one island, whichever of them stands first: a frame by range has all of them.
    island = flagged.withColumn("island", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy("track_id", "island").agg(F.min("a").alias("start_s"), F.max("b").alias("end_s"), F.count("*").alias("n")).drop("island")


def slot_features(tracks: DataFrame, before: int = 2, after: int = 2, text: str = "text", hidden: str | None = None, continuing: list[str] | None = None, exempt: list[str] | None = None, lead: int = 0) -> DataFrame:
    """H1: one row a slot: token_index, at (its word position), features and expected, if ``hidden`` names an array of the
    slots' words. features: array of (off, tok, joined) around it, padded; joined tells whether a rule may reach the token:
    before the slot only white space, commas and quotes may stand between, after it only white space, ``<BOS>`` has
    nothing before the first word. breaks: whether a sentence is taken to end at the slot (B20), judged from two words on
    each side, or as many as the longest phrase has. lead, if over 0: an array of up to so many lower-case words leftwards
    from the slot, as far as only white space parts them (for ``continues``). Only slots leave the text's row, never all its
    words."""
    keep = [c for c in tracks.columns if c not in (text, hidden)]
    labels = [hidden] if hidden else []
    rows = tracks.select(*keep, *labels, F.explode(F.array(T.rule_tokens(text))).alias("t")).select(*keep, *labels, F.col("t.words").alias("words"), F.col("t.gaps").alias("gaps"))
    offsets = [o for o in range(-before, after + 1) if o]

    def token(i: Column) -> Column:
        return F.when(i < 0, "<BOS>").when(i >= F.size("words"), "<EOS>").otherwise(F.lower(F.get("words", i)))

    def gap(i: Column) -> Column:
        """Before word i."""
        return F.when((i >= 0) & (i <= F.size("words")), F.get("gaps", i)).otherwise("")

    def joined(i: Column, o: int) -> Column:
        if o < 0:
            steps = [F.when(i + k > 0, gap(i + k).rlike(f"^{T.SOFT_GAP}\\z")).otherwise(gap(i + k) == "") for k in range(o + 1, 1)]
        else:
            steps = [(i + k >= F.size("words")) | gap(i + k).rlike(r"^\s+\z") for k in range(1, o + 1)]
        return reduce(lambda a, b: a & b, steps)

    longest = lambda phrases: max([2, *(len(x.split()) for x in phrases or [])])

    def breaks(i: Column) -> Column:
        word = lambda k: F.coalesce(F.when(k >= 0, F.get("words", k)), F.lit(""))
        head = F.concat(*[x for k in range(longest(continuing), 0, -1) for x in (word(i - k), gap(i - k + 1))])
        tail = F.concat(*[x for k in range(1, longest(exempt) + 1) for x in (gap(i + k), word(i + k))])
        return T.virtual_break(head, tail, continuing, exempt)

    def leading(i: Column) -> Column:
        """The words leftwards from word i up to the first gap that is not white space."""
        back = F.transform(F.sequence(F.lit(1), F.lit(lead)), lambda k: F.struct(k.alias("k"), F.when(i - k >= 0, F.lower(F.get("words", i - k))).alias("w"), F.coalesce(F.get("gaps", i - k + 1).rlike(r"^\s*\z"), F.lit(False)).alias("ok")))
        ends = F.array_min(F.transform(F.filter(back, lambda b: b["w"].isNull() | ~b["ok"]), lambda b: b["k"]))
        return F.transform(F.filter(back, lambda b: b["k"] < F.coalesce(ends, F.lit(lead + 1))), lambda b: b["w"])

    def slot(i: Column, k: Column) -> Column:
        around = F.array(*[F.struct(F.lit(o).alias("off"), token(i + o).alias("tok"), joined(i, o).alias("joined")) for o in offsets])
        return F.struct(k.alias("token_index"), i.alias("at"), around.alias("features"), breaks(i).alias("breaks"), *([leading(i).alias("lead")] if lead else []), *([F.get(hidden, k).alias("expected")] if hidden else []))

    places = F.filter(F.transform("words", lambda w, i: F.when(w == T.MARK, i)), lambda i: i.isNotNull())
    return rows.select(*keep, F.explode(F.transform(places, slot)).alias("s")).select(*keep, "s.*")


#: Phrases up to which they are broadcast.
PHRASES = 1 << 17


def phrase_paths(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Phrases as paths of a trie that is read from the last word backwards: path (lower-case words, last first) and
    depth. A path that passes another one's end is left out: the shorter phrase guards wherever it does. Phrases without a
    word go."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(phrase), "[’‘]", "'"), r"[\s\x{A0}]+", " ")
    way = F.reverse(F.filter(F.split(folded, " "), lambda w: w != ""))
    paths = phrases.select(way.alias("way")).where(F.size("way") > 0).distinct().select("way", F.array_join("way", " ").alias("path"), F.size("way").alias("depth"))
    above = paths.where("depth > 1").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.array_join(F.slice("way", 1, k), " "))).alias("end"))
    longer = above.join(paths.select(F.col("path").alias("end")), "end", "left_semi").select("path")
    return paths.join(longer, "path", "left_anti").select("path", "depth")


def continues(slots: DataFrame, paths: DataFrame) -> DataFrame:
    """B20 in matching: slots before which one of the phrases stands, however long, do not end a sentence: their ``breaks``
    become false. slots: track_id, token_index, breaks and lead (``slot_features`` with as many words as the longest
    phrase); paths: those of ``phrase_paths``. Up to PHRASES paths are broadcast, one lookup a length, and slots stay where
    they are; more paths meet by key the heads of those slots only that break."""
    head = lambda k: F.array_join(F.slice("lead", 1, k), " ")
    depths = sorted(r[0] for r in paths.select("depth").distinct().collect())
    if not depths:
        return slots
    if paths.limit(PHRASES + 1).count() <= PHRASES:
        rows = slots.withColumn("__held", F.lit(False))
        for k in depths:
            same = paths.where(F.col("depth") == k).select(F.col("path").alias("__path"))
            rows = rows.join(F.broadcast(same), F.col("breaks") & (F.size("lead") >= k) & (head(k) == F.col("__path")), "left")
            rows = rows.withColumn("__held", F.col("__held") | F.col("__path").isNotNull()).drop("__path")
        return rows.withColumn("breaks", F.col("breaks") & ~F.col("__held")).drop("__held")
    heads = F.transform(F.filter(F.array(*map(F.lit, depths)), lambda k: k <= F.size("lead")), head)
    held = slots.where("breaks").select("track_id", "token_index", F.explode(heads).alias("path")).join(paths, "path", "left_semi")
    held = held.select("track_id", "token_index", F.lit(True).alias("__held")).distinct()
    rows = slots.join(held, ["track_id", "token_index"], "left")
    return rows.withColumn("breaks", F.col("breaks") & F.col("__held").isNull()).select(slots.columns)


def discovery_features(texts: DataFrame, before: int = 2, after: int = 2, text: str = "text") -> DataFrame:
    """H2: one row a slot that starts a token: token_index (its number among the markers that are shown) and features, an
    array of (off, tok, boundary) over the white-space tokens around it once cues, notes and tags are blanked; boundary:
    the token ends a sentence before the slot, or starts with a sentence's sign after it."""
    keep = [c for c in texts.columns if c != text]
    clean = T.normalize_mask(text)
    for pattern in T.NO_SPEECH:
        clean = F.regexp_replace(clean, pattern, " ")
    rows = texts.select(*keep, F.explode(F.array(F.regexp_extract_all(clean, F.lit(r"(\[__\]|\S+)"), 1))).alias("tokens"))
    marks = F.flatten(F.transform("tokens", lambda w, i: F.array_repeat(F.struct(i.alias("at"), (w == T.MARK).alias("starts")), F.regexp_count(w, F.lit(r"\[__\]")))))
    placed = rows.select(*keep, "tokens", F.posexplode(marks).alias("token_index", "m")).where("m.starts")

    def feature(o: int) -> Column:
        i = F.col("m.at") + o
        tok = F.when(i < 0, "<BOS>").when(i >= F.size("tokens"), "<EOS>").otherwise(F.lower(F.get("tokens", i)))
        ends = tok.rlike(r"[.!?][\"'’”)}\]]*\z") if o < 0 else tok.rlike(r"^[.!?]")
        return F.struct(F.lit(o).alias("off"), tok.alias("tok"), ends.alias("boundary"))

    return placed.select(*keep, "token_index", F.array(*[feature(o) for o in range(-before, after + 1) if o]).alias("features"))
