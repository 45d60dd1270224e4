"""Alignment against brute force, and fixed cases of what SQL does not check."""

import random
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from slotloom.operators import align, chains, mining, slots

TIMED = "track_id long, token_index long, time_ms long"
OCCURRENCES = "track_id long, occ_index long, word string, start_ms long, end_ms long"


def best_assignment(times, spans, drift):
    """(matches, -total distance) of the best assignment in order, by trying everything."""
    times, spans = sorted(times), sorted(spans)

    @cache
    def best(i, j):
        if i == len(times) or j == len(spans):
            return 0, 0
        out = max(best(i + 1, j), best(i, j + 1))
        far = max(spans[j][0] - times[i], times[i] - spans[j][1], 0)
        if far <= drift:
            n, d = best(i + 1, j + 1)
            out = max(out, (n + 1, d - far))
        return out

    return best(0, 0)


def test_time_assignment_against_brute_force(spark):
    rng = random.Random(5)
    times = {t: [rng.randrange(40_000) for _ in range(rng.randrange(9))] for t in range(25)}
    spans = {t: [(a, a + rng.randrange(900)) for a in (rng.randrange(40_000) for _ in range(rng.randrange(9)))] for t in range(25)}
    spans[3], times[4], times[5], spans[5] = [], [], [7] * 6, [(5, 9)] * 4
    s = spark.createDataFrame([(t, i, a) for t, v in times.items() for i, a in enumerate(v)], TIMED)
    o = spark.createDataFrame([(t, i, "w", *a) for t, v in spans.items() for i, a in enumerate(v)], OCCURRENCES)
    for drift in (1500, 6000):
        got = align.align_time(s, o, drift).collect()
        for t in times:
            mine = [r for r in got if r.track_id == t]
            assert (len(mine), -sum(r.distance_ms for r in mine)) == best_assignment(tuple(times[t]), tuple(spans[t]), drift)
            pairs = sorted((times[t][r.token_index], spans[t][r.occ_index]) for r in mine)
            assert [b for _, b in pairs] == sorted(b for _, b in pairs)
            assert len({r.token_index for r in mine}) == len({r.occ_index for r in mine}) == len(mine)


def fewest_passed(times, spans, drift):
    """Of the best assignments the one that has passed the fewest occurrences at every slot, by a full table."""
    n, m = len(times), len(spans)
    far = lambda i, j: max(spans[j][0] - times[i], times[i] - spans[j][1], 0)
    never = (-1, 0)
    table = [[(0, 0)] + [never] * m]
    for i in range(n):
        last = table[-1]
        row = list(last)
        for j in range(m):
            if far(i, j) <= drift:
                best = max(last[: j + 1])
                if best > never:
                    row[j + 1] = max(row[j + 1], (best[0] + 1, best[1] - far(i, j)))
        table.append(row)
    j, out = max(range(m + 1), key=lambda j: (table[n][j], -j)), []
    for i in range(n - 1, -1, -1):
        if j and far(i, j - 1) <= drift:
            before = max(range(j), key=lambda x: (table[i][x], -x))
            if table[i][before] > never and (table[i][before][0] + 1, table[i][before][1] - far(i, j - 1)) == table[i + 1][j]:
                out.append((i, j - 1))
                j = before
    return out[::-1]


def test_blocks_do_not_change_the_assignment():
    """Summaries and states of blocks against one table over the whole track, with ties, long occurrences and empty blocks."""
    rng = random.Random(8)
    for case in range(120):
        span = rng.choice([60, 200, 900])
        times = sorted(rng.randrange(span) for _ in range(rng.randrange(1, 25)))
        spans = sorted((a, a + rng.choice([0, 2, 5, 5, 90])) for a in (rng.randrange(-20, span + 20) for _ in range(rng.randrange(1, 30))))
        drift, width = rng.choice([0, 3, 12]), rng.choice([7, 20, 64])
        want = fewest_passed(times, spans, drift)
        origin, parts, blocks = times[0], [], []
        for b in range((times[-1] - origin) // width + 1):
            begin = origin + b * width
            own = [i for i, t in enumerate(times) if begin <= t < begin + width]
            near = [j for j, (a, e) in enumerate(spans) if a - drift <= begin + width and e + drift >= begin]
            arrays = [np.array(x, np.int64) for x in ([times[i] for i in own], [spans[j][0] for j in near], [spans[j][1] for j in near])]
            blocks.append((own, near, chains.Block(*arrays, drift, begin, begin + width)))
            parts.append(blocks[-1][2].summary())
        half = len(parts) // 2
        merged = [m for m in (parts[:half], parts[half:]) if m]
        tops = []
        for group in merged:
            m = group[0]
            for p in group[1:]:
                m = chains.product(m, p)
            tops.append(m)
        outer, states = chains.states_between(tops, 0, chains.ANY), []
        for k, group in enumerate(merged):
            states += chains.states_between(group, outer[k], outer[k + 1])[(1 if k else 0) :]
        got = [(own[i], near[j]) for (own, near, block), s, e in zip(blocks, states[:-1], states[1:]) for i, j, _ in block.matches(s, e)]
        assert got == want, (case, times, spans, drift, width)


def test_one_dense_track_in_blocks(spark):
    """One track without a gap, in many blocks and two levels of summaries, equal to the same track in one block."""
    rng = random.Random(3)
    times, starts = [rng.randrange(200_000) for _ in range(3000)], [rng.randrange(200_000) for _ in range(2500)]
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(2, 0, 5), (3, 0, None)], TIMED)
    o = spark.createDataFrame([(1, i, "w", a, a + 40) for i, a in enumerate(starts)] + [(2, 0, "v", 9, 9), (3, 0, "v", 9, 9), (4, 0, "v", 9, 9)], OCCURRENCES)
    key = lambda df: sorted((r.track_id, r.token_index, r.occ_index, r.distance_ms) for r in df.collect())
    one, many = key(chains.align_drifts(s, o, (300,))), key(chains.align_drifts(s, o, (300,), width=1000))
    assert one == many and len(one) > 2000


def test_common_subsequence(spark):
    def plain(a, b):
        @cache
        def n(i, j):
            return 0 if i < 0 or j < 0 else n(i - 1, j - 1) + 1 if a[i] == b[j] else max(n(i - 1, j), n(i, j - 1))

        return n(len(a) - 1, len(b) - 1)

    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(7))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(align.common_subsequence("a", "b")).collect()] == [plain(tuple(a), tuple(b)) for a, b in rows]
    assert [r[0] for r in df.select(align._agree("a", "b")).collect()] == [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in rows]


CONTEXT = "lefts array<string>, rights array<string>"


def plain_context(slots_, tokens, margin=3.0):
    """Winners over all words within ten seconds: token_index, occ_index, word, score."""

    def agree(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    out = []
    for track, k, t, lefts, rights in slots_:
        scored = []
        for other, o, at, word, before, after in tokens:
            if other == track and abs(at - t) <= 10_000:
                xl, xr = agree(lefts, before), agree(rights, after)
                score = 5 * (xl + xr) + common(lefts, before) + common(rights, after) + (3 if xl and xr else 0) - 0.05 * abs(at - t) / 1000
                scored.append((-score, o, word, xl, xr))
        scored.sort(key=lambda x: x[:2])
        if lefts and rights and scored:
            score, o, word, xl, xr = scored[0]
            if xl and xr and word is not None and (len(scored) == 1 or scored[1][0] - score >= margin):
                out.append((track, k, o, word, round(-score, 6)))
    return sorted(out)


def test_context_alignment_against_all_pairs(spark):
    """Few different words, so that words next to a slot agree often, and also candidates that agree on no side win."""
    rng, slots_, tokens = random.Random(12), [], []
    for track in range(12):
        words = [rng.choice("abcdefgh"[: 3 + track % 6]) for _ in range(70)]
        at = [700 * i + rng.randrange(300) for i in range(70)]
        tokens += [(track, i, at[i], w if w in "abc" else None, words[max(0, i - 15) : i][::-1], words[i + 1 : i + 16]) for i, w in enumerate(words)]
        noisy = [w if rng.random() < 0.8 else "x" for w in words]
        slots_ += [(track, k, at[i] + rng.randrange(-400, 400), noisy[max(0, i - 10) : i][::-1], noisy[i + 1 : i + 11]) for k, i in enumerate(sorted(rng.sample(range(70), 30)))]
    s = spark.createDataFrame(slots_, "track_id long, token_index long, time_ms long, lefts array<string>, rights array<string>")
    o = spark.createDataFrame(tokens, "track_id long, occ_index long, time_ms long, word string, lefts array<string>, rights array<string>")
    want = plain_context(slots_, tokens)
    got = sorted((r.track_id, r.token_index, r.occ_index, r.word, round(r.score, 6)) for r in align.align_context(s, o).collect())
    assert got == want and len(want) > 20
    # Some are decided by a candidate that agrees on neither side.
    sided = [t for t in tokens]
    assert len(plain_context(slots_, sided, margin=0.0)) > len(want)


def test_hidden_texts_of_any_length(spark):
    long_ = "word " * 300_000
    same = "track_id long, event_index long, start_ms long, dur_ms long, text string"
    masked, plain = spark.createDataFrame([(1, 0, 0, 9, "a [__] b [__] c")], same), spark.createDataFrame([(1, 0, 0, 9, f"a {long_} b that c")], same)
    got = align.align_direct(masked, plain).orderBy("slot_in_event").collect()
    assert [(r.status, len(r.expected)) for r in got] == [("ambiguous", len(long_) - 1), ("known", 4)]


def test_context_alignment(spark):
    s = spark.createDataFrame([(1, 0, 1000, ["b", "a"], ["c", "d"]), (1, 1, 9000, ["x"], ["y"]), (1, 2, 30_000, ["b"], ["c"]), (1, 3, 1000, [], ["c"])], f"{TIMED}, {CONTEXT}")
    o = spark.createDataFrame(
        [(1, 5, 1500, "that", ["b", "a"], ["c", "d"]), (1, 6, 2500, "this", ["b", "q"], ["q", "d"]), (1, 7, 9000, "that", ["x"], ["y"]), (1, 8, 9500, "this", ["x"], ["y"])],
        f"track_id long, occ_index long, time_ms long, word string, {CONTEXT}",
    )
    got = {(r.token_index, r.occ_index, r.word, round(r.score, 3)) for r in align.align_context(s, o).collect()}
    # slot 0: 5 * 4 + 3 + 4 - 0.025; slot 1 has two equal candidates; slot 2 none in reach; slot 3 no left side
    assert got == {(0, 5, "that", 26.975)}
    assert align.align_context(s, o.withColumn("word", F.lit(None).cast("string"))).count() == 0


def test_merged_and_shifted(spark):
    context = spark.createDataFrame([(1, 0, 10, "a", 9.0), (1, 1, 10, "a", 12.0), (1, 2, 11, "b", 5.0)], "track_id long, token_index long, occ_index long, word string, score double")
    time = spark.createDataFrame([(1, 0, 12, "c"), (1, 1, 13, "d"), (1, 3, 10, "a"), (1, 4, 14, "e")], "track_id long, token_index long, occ_index long, word string")
    fixed = spark.createDataFrame([(1, 2, "z")], "track_id long, token_index long, word string")
    got = {(r.token_index, r.occ_index, r.word, r.source) for r in align.merge_alignments(context, time, fixed).collect()}
    assert got == {(1, 10, "a", "context"), (0, 12, "c", "time"), (4, 14, "e", "time"), (2, None, "z", "fixed")}

    s = spark.createDataFrame([(1, 0, 1000), (1, 1, 9000), (2, 0, 1000)], TIMED)
    o = spark.createDataFrame([(1, 0, "a", 6000, 6100), (1, 1, "b", 14_000, 14_100), (2, 0, "c", 6000, 6100)], OCCURRENCES)
    offsets = spark.createDataFrame([(1, 5000.0), (2, 500.0)], "track_id long, offset_ms double")
    known = spark.createDataFrame([(1, 1, 9)], "track_id long, token_index long, occ_index long")
    assert {(r.track_id, r.token_index, r.occ_index, r.word) for r in align.align_shifted(s, o, offsets, known).collect()} == {(1, 0, 0, "a")}


def test_sentence_context(spark):
    tracks = spark.createDataFrame([(1, "One two. Then Mr. Gray saw [__] there. And more words go on after that."), (2, "no slot"), (3, None)], "track_id long, text string")
    assert [(r.track_id, r.context, r.fallback) for r in slots.sentence_context(tracks).collect()] == [(1, "Then Mr. Gray saw [__] there. And more words", False)]
    assert [(r.context, r.fallback) for r in slots.sentence_context(tracks, words=1, most=20).collect()] == [("saw [__] there.", True)]


def test_selection_and_audit(spark):
    hits = [("p", "a", i, "a") for i in range(5)] + [("q", "a", i, "a") for i in range(4)] + [("q", "a", 9, "a"), ("r", "b", 10, "b"), ("r", "b", 11, "b"), ("s", "c", 12, "c"), ("s", "c", 13, "x")]
    df = spark.createDataFrame(hits, "pattern string, word string, row_id long, expected string")
    assert [(r.rank, r.pattern, r.correct, r.wrong) for r in mining.greedy_select(df).orderBy("rank").collect()] == [(0, "p", 5, 0), (1, "r", 2, 0)]

    schema = "leaf_key string, target string, units long, precision double"
    leads = spark.createDataFrame([("k", "a", 9, 1.0), ("l", "a", 9, 1.0), ("m", "a", 9, 1.0)], schema)
    other = spark.createDataFrame([("k", "b", 9, 1.0), ("l", "b", 1, 1.0)], schema)
    assert {(r.leaf_key, r.other_target, r.veto) for r in mining.cross_tier_audit(leads, other).collect()} == {("k", "b", True), ("l", "b", False), ("m", None, False)}


def test_train_only(spark):
    """Half 0 teaches the class of 'dog'; half 1 has too few to teach one."""
    rows = [(i, 0, "manual", "that", f"c{i % 3}") for i in range(6)] + [(10 + i, 1, "manual", "that", f"c{i % 3}") for i in range(2)]
    tags = [(r[0], r[1], off, tok, cls) for r in rows for off, tok, cls in ((-1, "dog", "noun"), (1, "runs", None))]
    got = mining.train_only_check(spark.createDataFrame(tags, "row_id long, half int, off int, tok string, cls string"), spark.createDataFrame(rows, "row_id long, half int, tier string, expected string, creator string"))
    assert {(r.trained_on, r.pattern, r.half, r.n, r.passes) for r in got.collect()} == {(0, "dog [] runs", 1, 2, False), (0, "<noun> [] runs", 1, 2, False), (1, "dog [] runs", 0, 6, True)}


def spoken(spark, seed):
    """Lines of random words in both versions, some without a word, of one word or without a duration."""
    rng, masked, plain = random.Random(seed), [], []
    for track in range(6):
        at = 0
        for i in range(12):
            words = [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 1, 3, 40]))]
            dur = rng.choice([0, 700 * len(words)])
            hidden = [rng.random() < 0.2 for _ in words]
            masked.append((track, i, at, dur, " ".join("[__]" if h else w for w, h in zip(words, hidden))))
            plain.append((track, i, at, dur, " ".join(words)))
            at += dur
    kind = "track_id long, event_index int, start_ms long, dur_ms long, text string"
    return spark.createDataFrame(masked, kind), spark.createDataFrame(plain, kind)


def timed_words(events):
    """track: (unit, ms) in order, by a plain loop."""
    out = {}
    for e in sorted(events.collect(), key=lambda e: (e.track_id, e.event_index)):
        units = e.text.split()
        out.setdefault(e.track_id, []).extend((u, round((e.start_ms + e.dur_ms * k / len(units)) / 1000.0 * 1000)) for k, u in enumerate(units))
    return out


def test_spoken_context_never_sorts_words(spark):
    masked, _ = spoken(spark, 3)
    want = {}
    for track, words in timed_words(masked).items():
        for p, (unit, ms) in enumerate(words):
            if unit == "[__]":
                after = words[p + 1] if p + 1 < len(words) else None
                near = sum(1 for q, (_, m) in enumerate(words) if m >= ms - 3000 and (m < ms or m == ms and q < p))
                want[track, p] = (near, after[0] if after and after[1] - ms <= 500 and after[0] != "[__]" else None)
    got = slots.spoken_context(slots.spoken_lines(masked), 3, 0.5)
    assert {(r.track_id, r.position): (r.preceding, r.next_word) for r in got.collect()} == want and len(want) > 50
    positions = [(r.track_id, r.position, r.unit) for r in slots.spoken_words(masked).orderBy("track_id", "position").collect()]
    assert positions == [(t, p, u) for t, words in timed_words(masked).items() for p, (u, _) in enumerate(words)]
    # one sort, of events, below the words' explode
    plan = slots.spoken_words(masked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.index("posexplode") < plan.index("Window")


def test_words_with_neighbours_stay_in_their_line(spark):
    """E4 and E6 on lines give what they give on all words with their neighbours; few words leave their line."""
    masked, plain = spoken(spark, 5)
    side = lambda words, i, n: (words[max(0, i - n) : i][::-1], words[i + 1 : i + n + 1])
    own, all_ = [], []
    for track, words in timed_words(masked).items():
        units = [u for u, _ in words]
        places = [i for i, u in enumerate(units) if u == "[__]"]
        own += [(track, k, words[i][1], *side(units, i, 10)) for k, i in enumerate(places)]
    for track, words in timed_words(plain).items():
        units = [u for u, _ in words]
        all_ += [(track, i, ms, u if u in "ab" else None, *side(units, i, 15)) for i, (u, ms) in enumerate(words)]
    s = spark.createDataFrame(own, f"{TIMED}, {CONTEXT}")
    o = spark.createDataFrame(all_, f"track_id long, occ_index long, time_ms long, word string, {CONTEXT}")
    lines = slots.spoken_lines(plain)
    cols = ["track_id", "position", "time_ms", "unit", "lefts", "rights"]
    rows = lambda df: sorted(map(repr, df.collect()))
    every = align.likely_tokens(lines, s, most=0).select(cols)
    assert rows(every) == rows(o.join(s.select("track_id").distinct(), "track_id", "left_semi").join(every.select("track_id", F.col("position").alias("occ_index"), "unit"), ["track_id", "occ_index"]).select("track_id", F.col("occ_index").alias("position"), "time_ms", "unit", "lefts", "rights"))
    few = align.likely_tokens(lines, s)
    assert len(own) <= few.count() < 0.6 * o.count()
    tokens = few.select("track_id", F.col("position").alias("occ_index"), "time_ms", F.when(F.col("unit").isin("a", "b"), F.col("unit")).alias("word"), "lefts", "rights")
    for margin in (3.0, 0.0):
        want = rows(align.align_context(s, o, margin))
        assert rows(align.align_context(s, tokens, margin, lines=lines)) == want and len(want) > 3
    wanted = ["track_id", "offset_ms", "pairs"]
    assert rows(align.track_offset(s, tokens).select(wanted)) == rows(align.track_offset(s, o).select(wanted))


def test_rivals_of_crowded_tracks(spark):
    """Tracks with too many open slots meet their words by time, with the same pairs but such as are surely beaten."""
    masked, plain = spoken(spark, 7)
    lines = slots.spoken_lines(plain)
    marks = F.filter(F.transform("units", lambda u, i: F.when(u == "[__]", i)), lambda i: i.isNotNull())
    low = align.sided(align.wide_lines(slots.spoken_lines(masked), 10), marks, 10).where((F.size("lefts") > 0) & (F.size("rights") > 0))
    low = low.select("track_id", F.col("position").alias("token_index"), "time_ms", "lefts", "rights", F.lit(40.0).alias("best"))
    able = lambda df: sorted(map(repr, df.where("xl = 0 OR xr = 0").where("best - base - most < 3").select("track_id", "token_index", "base", "most").collect()))
    in_place = able(align._rivals(low, lines, 2000, 3.0))
    assert in_place == able(align._rivals(low, lines, 2000, 3.0, most=0)) and in_place
