"""Rules chosen from patterns: the gate over halves of the creators (H21) and the greedy choice.

``greedy_select`` takes many patterns at once and yet those that taking one at a time would. Any pattern taken before a
given one has a score as high at least, and a score rises only where patterns taken before have covered wrong rows. So, for a
level s, the patterns that may be taken at s or more, now or later, are those with that score now and, again and again, those
that reach it without the wrong rows they share with one of them; what they reach is a bound of their score. A pattern whose
score is higher than the bound of every other one on its rows comes before all of them, and nothing of its own changes until
then: all such patterns are taken in one round. Where there is none, the best of all is. Tiers come first in the order: a
pattern of a later tier waits for those of earlier tiers that may still be taken at all.

Rows stay where they are, each with the patterns that match it; equal ones are one row and its number. A sweep is one pass over
them without a shuffle of rows: tasks get the state of the patterns (some numbers each) and add up counts by pattern. The driver
holds those numbers for the patterns that passed the gate, which are the candidates for rules.

A level is as low as the matches of its patterns are few enough for the driver (``HELD``, counted in a sweep). Nothing else
decides what is taken at that level, so the driver gets those matches alone and takes all of the level's patterns one by one.
Where not even the best pattern's matches are that few, the level is taken in rounds, a sweep each.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.functions.text import wilson_lower
from slotloom.sources.scratch import cut

#: Patterns up to which they are broadcast.
PATTERNS = 1 << 18


@dataclass(frozen=True)
class Gate:
    """What a pattern's word must reach in a tier: rows, share, creators of right rows, and in ``strict`` also the lower bound
    of its share; there the other tiers, where they have ``times`` rows, must agree. Tiers are tried in order."""

    tiers: tuple[str, ...] = ("discovery", "manual")
    strict: str = "manual"
    times: int = 5
    share: float = 0.92
    creators: int = 2
    lower: float = 0.8

    def passes(self, tier: Column, n: Column, right: Column, enough: Column, other: Column, other_right: Column) -> Column:
        sure = (wilson_lower(right, n) >= self.lower) & ((other < self.times) | (other_right / other >= self.share))
        return F.coalesce((n >= self.times) & (right / n >= self.share) & enough & ((tier != self.strict) | sure), F.lit(False))

    def rank(self, tier: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, self.tiers)), tier).cast("int")


def _scoped_choice(counts: DataFrame, gate: Gate) -> DataFrame:
    """pattern, scope, word, tier: the first tier whose top word passes. counts: pattern, scope, tier, expected, n, creators
    (of the expected word)."""
    both, w, elsewhere = Window.partitionBy("pattern", "scope"), Window.partitionBy("pattern", "scope", "tier"), F.when(F.col("tier") != gate.strict, F.col("n")).otherwise(0)
    counts = counts.withColumn("other", F.sum(elsewhere).over(both)).withColumn("other_right", F.sum(elsewhere).over(Window.partitionBy("pattern", "scope", "expected")))
    top = counts.withColumn("total", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "expected"))).where("k = 1")
    good = top.where(gate.passes(F.col("tier"), F.col("total"), F.col("n"), F.col("creators") >= gate.creators, F.col("other"), F.col("other_right")))
    return good.groupBy("pattern", "scope").agg(F.min_by(F.struct(F.col("expected").alias("word"), "tier"), gate.rank(F.col("tier"))).alias("choice")).select("pattern", "scope", "choice.*")


def _small(patterns: DataFrame) -> DataFrame:
    """Patterns with a hint to broadcast them, if they are few; a written table."""
    return F.broadcast(patterns) if patterns.count() <= PATTERNS else patterns


def creator_gate(hits: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Pattern, word and tier where the choice over all rows is also that over either half of the creators (each learned
    on one half and checked on the other), and where the word passes again on the rows that have no prediction, in all and
    in either half. hits: pattern, row_id, half (of the creator), tier, expected, creator, predicted; rows without a label
    do not count. One pass finds the patterns with enough open rows, another makes counts by word; the scopes add those up, as a
    creator is in one half only."""
    known = hits.where(F.col("expected").isNotNull() & F.col("tier").isin(*gate.tiers) & F.col("half").isin(0, 1))
    open_ = F.col("predicted").isNull()
    # A pattern that passes has so many open rows in either half; most have fewer, and are not counted any further.
    often = known.where(open_).groupBy("pattern").agg(*[F.count_if(F.col("half") == h).alias(f"n{h}") for h in (0, 1)]).where((F.col("n0") >= gate.times) & (F.col("n1") >= gate.times)).select("pattern")
    known = known.join(_small(cut(often, "often")), "pattern", "left_semi")
    people = known.groupBy("pattern", "half", "tier", "expected", "creator").agg(F.count("*").alias("n"), F.count_if(open_).alias("open"))
    counts = people.groupBy("pattern", "half", "tier", "expected").agg(F.sum("n").alias("n"), F.count("creator").alias("creators"), F.sum("open").alias("open"), F.count(F.when(F.col("open") > 0, F.col("creator"))).alias("open_creators"))
    scopes = F.explode(F.array(F.lit(-1), F.col("half"))).alias("scope")
    counts = cut(counts, "gate-counts").select("pattern", "tier", "expected", "n", "creators", "open", "open_creators", scopes).groupBy("pattern", "scope", "tier", "expected").agg(*[F.sum(c).alias(c) for c in ("n", "creators", "open", "open_creators")])
    choice = _scoped_choice(counts, gate).groupBy("pattern").agg(F.count("*").alias("scopes"), F.min("word").alias("word"), F.max("word").alias("last"), F.min("tier").alias("tier"), F.max("tier").alias("last_tier"))
    agreed = choice.where("scopes = 3 AND word = last AND tier = last_tier").select("pattern", "word", F.col("tier").alias("own"))
    mine, right = F.col("tier") == F.col("own"), F.col("expected") == F.col("word")
    total = lambda when, c="open": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    left = counts.join(agreed, "pattern").groupBy("pattern", "scope", "word", "own").agg(total(mine).alias("n"), total(mine & right).alias("right"), total(mine & right, "open_creators").alias("people"), total(F.col("tier") != gate.strict).alias("other"), total((F.col("tier") != gate.strict) & right).alias("other_right"))
    good = left.where(gate.passes(F.col("own"), F.col("n"), F.col("right"), F.col("people") >= gate.creators, F.col("other"), F.col("other_right")))
    return good.groupBy("pattern", "word", F.col("own").alias("tier")).agg(F.count("*").alias("scopes")).where("scopes = 3").drop("scopes")


def gated_hits(patterns: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """The rows that no prediction fills yet of the patterns that pass ``creator_gate``, as ``greedy_select`` takes them.
    patterns: as for the gate; a large table that is used three times."""
    chosen = _small(cut(creator_gate(patterns, gate), "chosen"))
    rows = patterns.where(F.col("predicted").isNull() & F.col("expected").isNotNull() & F.col("tier").isin(*gate.tiers) & F.col("half").isin(0, 1))
    return rows.withColumnRenamed("tier", "row_tier").join(chosen, "pattern")


#: Sums that a sweep makes by pattern, in all and by half of the creators.
SUMS = ("entries", "correct", "wrong", "stuck", "n0", "n1", "right0", "right1", "other0", "other1", "other_right0", "other_right1")
EXTREMES = ("rival", "least0", "least1", "most0", "most1")
#: What a sweep knows of a row besides its patterns.
FACTS = ("place", "other", "half", "creator")
FAR = np.iinfo(np.int64).max
#: A level that is taken in rounds is the best score divided by this.
LEVEL = 4
#: Matches (of a pattern and a row) that the driver holds at once; with what is counted from them, up to 100 bytes each.
HELD = 1 << 21


@dataclass
class _State:
    """What tasks know of the patterns: place of the tier (its own rows are those of that place), whether taken, whether it
    may be taken at the present level, and the key of its bound (``_key``; FAR where it may not)."""

    place: np.ndarray
    taken: np.ndarray
    able: np.ndarray
    bound: np.ndarray


def _key(place: np.ndarray, score: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Whole numbers in the order in which patterns are taken: tier, falling score, number of the pattern."""
    return (place.astype(np.int64) << 58) + ((np.int64(1) << 33) - score.astype(np.int64) << 24) + (np.arange(len(place)) if at is None else at)


def _flat(batch: pa.RecordBatch, state: _State) -> tuple[np.ndarray, ...]:
    """Of the rows that no pattern taken covers: at, ok and the row's number, by match."""
    lists = batch.column(0)
    at, ok, row = lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    covered = np.zeros(len(lists), bool)
    covered[row[state.taken[at]]] = True
    keep = ~covered[row]
    return at[keep], ok[keep].astype(bool), row[keep]


def _sweep(batch: pa.RecordBatch, state: _State) -> dict[str, np.ndarray]:
    """Counts by pattern of one batch of rows: at, ok (lists), place, other, half, creator (a hash), times."""
    lists, n = batch.column(0), len(state.place)
    at, ok, row = _flat(batch, state)
    place, other, half, creator, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
    own = place[row] == state.place[at]
    add = lambda mask: np.bincount(at[mask], times[row[mask]], n).astype(np.int64)
    able = state.able[at]
    alone = np.bincount(row[able], minlength=len(lists))[row] - able == 0
    out = {"entries": np.bincount(at, minlength=n), "correct": add(ok), "wrong": add(~ok), "stuck": add(own & ~ok & alone)}
    for h in (0, 1):
        here = half[row] == h
        far = here & other[row].astype(bool)
        out |= {f"n{h}": add(here & own), f"right{h}": add(here & own & ok), f"other{h}": add(far), f"other_right{h}": add(far & ok)}
        mine = here & own & ok
        least, most = np.full(n, FAR), np.full(n, -FAR)
        np.minimum.at(least, at[mine], creator[row[mine]])
        np.maximum.at(most, at[mine], creator[row[mine]])
        out |= {f"least{h}": least, f"most{h}": most}
    # The best bound of another pattern on a row: the best one, or for the best one itself the second.
    order = np.lexsort((state.bound[at], row))
    first = np.ones(len(order), bool)
    first[1:] = row[order][1:] != row[order][:-1]
    heads = np.flatnonzero(first)
    best, second = np.full(len(lists), FAR), np.full(len(lists), FAR)
    best[row[order[heads]]] = state.bound[at[order[heads]]]
    more = heads[np.append(np.diff(heads), len(order) - heads[-1:]) > 1] if len(heads) else heads
    second[row[order[more + 1]]] = state.bound[at[order[more + 1]]]
    rival = np.where(state.bound[at] == best[row], second[row], best[row])
    out["rival"] = np.full(n, FAR)
    np.minimum.at(out["rival"], at, rival)
    return out


def _counts(rows: DataFrame, state: _State) -> dict[str, np.ndarray]:
    """One sweep over all rows."""
    shared, n = rows.sparkSession.sparkContext.broadcast(state), len(state.place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, v in _sweep(batch, shared.value).items():
                total[k] = v if k not in total else np.minimum(total[k], v) if k in ("rival", "least0", "least1") else np.maximum(total[k], v) if k in EXTREMES else total[k] + v
        if total:
            seen = np.flatnonzero(total["entries"])
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(total[k][seen].astype(np.int64)) for k in (*SUMS, *EXTREMES))], ["at", *SUMS, *EXTREMES])

    found = rows.mapInArrow(run, "at bigint, " + ", ".join(f"{k} bigint" for k in (*SUMS, *EXTREMES)))
    added = found.groupBy("at").agg(*[F.sum(k).alias(k) for k in SUMS], *[(F.max(k) if k.startswith("most") else F.min(k)).alias(k) for k in EXTREMES]).toArrow()
    shared.destroy()
    at = added["at"].to_numpy()
    out = {k: np.zeros(n, np.int64) for k in SUMS} | {k: np.full(n, -FAR if k.startswith("most") else FAR) for k in EXTREMES}
    for k in (*SUMS, *EXTREMES):
        out[k][at] = added[k].to_numpy()
    # Two creators are told by the least and the greatest hash.
    return out | {f"several{h}": out[f"least{h}"] < out[f"most{h}"] for h in (0, 1)}


def _wilson(k: np.ndarray, n: np.ndarray, z: float = 1.96) -> np.ndarray:
    n = np.maximum(n, 1)
    p = k / n
    return (p + z * z / (2 * n) - z * np.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def _passing(c: dict[str, np.ndarray], gate: Gate, strict: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the rows left pass the gate, whether they ever can): rows only leave, so counts only fall."""
    passes = alive = np.ones(len(strict), bool)
    for h in ("0", "1", ""):
        n, right, other, other_right = (c[k + h] if h else c[k + "0"] + c[k + "1"] for k in ("n", "right", "other", "other_right"))
        sure = (_wilson(right, n) >= gate.lower) & ((other < gate.times) | (other_right >= gate.share * other))
        passes = passes & (n >= gate.times) & (right >= gate.share * n) & (~strict | sure)
        if h:
            enough = c["several" + h] if gate.creators == 2 else right >= gate.creators
            passes, alive = passes & enough, alive & enough & (n >= gate.times) & (right >= gate.share * gate.times) & (~strict | (_wilson(right, right) >= gate.lower))
    return passes, alive


def _held(rows: DataFrame, state: _State) -> pa.Table:
    """The rows with a pattern that may be taken, and of their patterns those, numbered anew."""
    shared = rows.sparkSession.sparkContext.broadcast((state, np.cumsum(state.able) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, number = shared.value
        for batch in batches:
            at, ok, row = _flat(batch, state)
            keep = state.able[at]
            at, ok, row = number[at[keep]], ok[keep], row[keep]
            here, size = np.unique(row, return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((at, pa.int32()), (ok, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*lists, *(batch.column(i).take(pa.array(here)) for i in range(2, 7))], ["at", "ok", *FACTS, "times"])

    out = rows.mapInArrow(run, "at array<int>, ok array<boolean>, place bigint, other boolean, half int, creator bigint, times bigint").toArrow()
    shared.destroy()
    return out.combine_chunks()


def _one_by_one(table: pa.Table, place: np.ndarray, strict: np.ndarray, wanted: np.ndarray, cost: int, gate: Gate | None) -> list[tuple[int, int, int, int]]:
    """The plain choice: pattern, score, correct and wrong of each as it is taken, while one reaches what is ``wanted`` of it.
    Only the patterns on the rows that one covers are counted anew. table: as of ``_held``."""
    if not table.num_rows:
        return []
    m, lists = len(place), table["at"].chunk(0)
    at, ok = lists.flatten().to_numpy(), table["ok"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(bool)
    size = np.diff(lists.offsets.to_numpy())
    start, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    facts = [table[c].to_numpy() for c in (*FACTS, "times")]
    (own_place, other, half), times = facts[:3], facts[4]
    _, creator = np.unique(facts[3], return_inverse=True)
    own, far = own_place[row] == place[at], other[row].astype(bool)
    parts = {"correct": ok, "wrong": ~ok}
    for h in (0, 1):
        here = half[row] == h
        parts |= {f"n{h}": here & own, f"right{h}": here & own & ok, f"other{h}": here & far, f"other_right{h}": here & far & ok}
    # The creators of right rows by pattern and half: a match's place among them, or -1.
    mine = own & ok & np.isin(half[row], (0, 1))
    keys, group = np.unique(((at[mine].astype(np.int64) * 2 + half[row[mine]]) * (creator.max() + 1)) + creator[row[mine]], return_inverse=True)
    team, people = np.full(len(at), -1), np.zeros(2 * m, np.int64)
    team[mine] = group
    left, spot = np.bincount(group, times[row[mine]], len(keys)), keys // (creator.max() + 1)
    np.add.at(people, spot, 1)
    add = lambda idx, number, n: {k: np.bincount(number[p[idx]], times[row[idx[p[idx]]]], n).astype(np.int64) for k, p in parts.items()}
    c = add(np.arange(len(at)), at, m)

    def keyed(of: np.ndarray) -> None:
        now = {k: v[of] for k, v in c.items()} | {f"several{h}": people[2 * of + h] > 1 for h in (0, 1)}
        right, count = now["right0"] + now["right1"], now["n0"] + now["n1"]
        score[of] = right - cost * (count - right)
        passes = _passing(now, gate, strict[of])[0] if gate is not None else np.ones(len(of), bool)
        key[of] = np.where(passes & (score[of] >= wanted[of]), _key(place[of], score[of], of), FAR)

    score, key = np.zeros(m, np.int64), np.full(m, FAR)
    keyed(np.arange(m))
    by_pattern = np.argsort(at, kind="stable")
    first = np.searchsorted(at[by_pattern], np.arange(m + 1))
    open_, out = np.ones(len(size), bool), []
    while key[p := int(key.argmin())] < FAR:
        out.append((p, int(score[p]), int(c["correct"][p]), int(c["wrong"][p])))
        gone = row[by_pattern[first[p] : first[p + 1]]]
        gone = gone[open_[gone]]
        open_[gone] = False
        n = size[gone]
        idx = np.repeat(start[gone] - np.cumsum(n) + n, n) + np.arange(n.sum())
        of, number = np.unique(at[idx], return_inverse=True)
        for k, v in add(idx, number, len(of)).items():
            c[k][of] -= v
        teams, number = np.unique(team[idx], return_inverse=True)
        less = np.bincount(number, times[row[idx]])
        less, teams = less[teams >= 0], teams[teams >= 0]
        left[teams] -= less
        np.subtract.at(people, spot[teams[left[teams] == 0]], 1)
        keyed(of)
        key[p] = FAR
    return out


def _lowest(score: np.ndarray, entries: np.ndarray, ahead: int, least: int, room: int) -> int:
    """The lowest level whose patterns have at most ``room`` matches, with the ``ahead`` ones of earlier tiers. score, entries:
    of a tier's patterns."""
    order = np.argsort(-score, kind="stable")
    over = np.flatnonzero(ahead + np.cumsum(entries[order]) > room)
    return max(least, int(score[order[over[0]]]) + 1) if len(over) else least


def greedy_select(hits: DataFrame, most: int | None = None, least: int = 2, cost: int = 3, gate: Gate | None = None, rounds: list[int] | None = None, held: int = HELD) -> DataFrame:
    """Patterns taken one by one by right - ``cost`` * wrong over the rows not covered yet, until the best score is under
    ``least`` (or the first ``most``); ties by pattern. hits: pattern, word, row_id, expected; with a gate also tier (the
    pattern's), row_tier, half and creator (``gated_hits``): then only rows of the pattern's tier count for its score, tiers
    come in the gate's order, and a pattern is taken only if the rows left pass the gate. Rows without a label are wrong.
    rounds: gets how many patterns each round or level took; held: the matches that the driver may hold at once."""
    spark = hits.sparkSession
    schema = "rank int, pattern string, word string, tier string, score bigint, correct bigint, wrong bigint"
    if gate is not None and gate.creators > 2:
        raise ValueError("the greedy choice tells one creator from more, not how many")
    tier = F.col("tier") if gate is not None else F.lit("")
    hits = cut(hits.withColumn("own_tier", tier), "pattern-hits")
    names = hits.groupBy("pattern").agg(F.first("word").alias("word"), F.first("own_tier").alias("tier")).toArrow().to_pylist()
    names.sort(key=lambda r: r["pattern"])
    n = len(names)
    if not n:
        return spark.createDataFrame([], schema)
    place = np.array([gate.tiers.index(r["tier"]) if gate is not None else 0 for r in names])
    strict = np.array([gate is not None and r["tier"] == gate.strict for r in names])
    known = spark.createDataFrame([(r["pattern"], i) for i, r in enumerate(names)], "pattern string, at bigint")
    ok = F.coalesce(F.col("expected") == F.col("word"), F.lit(False))
    facts = (gate.rank(F.col("row_tier")).cast("bigint") - 1, F.col("row_tier") != gate.strict, F.col("half").cast("int"), F.xxhash64("creator")) if gate is not None else (F.lit(0).cast("bigint"), F.lit(False), F.lit(0), F.lit(0).cast("bigint"))
    hits = hits.select("pattern", "row_id", ok.alias("ok"), *[f.alias(a) for f, a in zip(facts, FACTS)]).join(F.broadcast(known) if n <= PATTERNS else known, "pattern")
    # A row has the patterns that its own few words make.
    rows = hits.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("at", "ok"))).alias("l"), *[F.first(c).alias(c) for c in FACTS])
    rows = rows.groupBy("l", *FACTS).agg(F.count("*").alias("times"))
    rows = cut(rows.select(F.col("l.at").alias("at"), F.col("l.ok").alias("ok"), *FACTS, "times"), "pattern-rows")

    state = _State(place, np.zeros(n, bool), np.zeros(n, bool), np.full(n, FAR))
    level, closed, room, dead, chosen = None, False, held, np.zeros(n, bool), {}
    while True:
        c = _counts(rows, state)
        right, count = c["right0"] + c["right1"], c["n0"] + c["n1"]
        score = right - cost * (count - right)
        passes, alive = _passing(c, gate, strict) if gate is not None else (np.ones(n, bool), np.ones(n, bool))
        dead = dead | state.taken | ~alive | (right < least)
        ready = ~dead & passes & (score >= least)
        if not ready.any():
            break
        here = int(place[ready].min())
        ready &= place == here
        best = int(score[ready].max())
        if level is None or level[0] != here or best < level[1]:
            room = room if level is None else held
            of, ahead = ~dead & (place == here) & (score >= least), ~dead & (place < here) & (score >= least)
            low = _lowest(score[of], c["entries"][of], int(c["entries"][ahead].sum()), least, room)
            few = low <= best
            level, closed = (here, low if few else max(least, -(-best // LEVEL))), False
            wanted = np.where(place < here, least, np.where(place == here, level[1], FAR))
            state = replace(state, able=~dead & (score >= wanted), bound=np.full(n, FAR))
            continue
        # What it would have without all wrong rows that it shares with a pattern that may be taken.
        reach = np.maximum(score, right - cost * c["stuck"])
        if not closed:
            more = ~dead & ~state.able & (reach >= wanted)
            closed = not more.any()
            if closed and few:
                if c["entries"][state.able].sum() > held:
                    level, room = None, room // 4
                    continue
                able = np.flatnonzero(state.able)
                found = _one_by_one(_held(rows, state), place[able], strict[able], wanted[able], cost, gate)
                for p, *facts in found:
                    chosen[int(able[p])] = (len(chosen), *facts)
                if rounds is not None:
                    rounds.append(len(found))
                taken = state.taken.copy()
                taken[able[[p for p, *_ in found]]] = True
                state = replace(state, taken=taken, able=np.zeros(n, bool))
                level, room = None, held
                continue
            state = replace(state, able=state.able | more, bound=np.where(state.able, _key(place, reach), FAR) if closed else state.bound)
            continue
        ready &= score >= level[1]
        own = _key(place, score)
        found = np.flatnonzero(ready & (own < c["rival"])).tolist()
        if not found:
            found = [int(np.flatnonzero(ready)[own[ready].argmin()])]
        chosen |= {i: (len(chosen), int(score[i]), int(c["correct"][i]), int(c["wrong"][i])) for i in found}
        if rounds is not None:
            rounds.append(len(found))
        taken = state.taken.copy()
        taken[found] = True
        # Bounds only fall: rows have left, and so may have patterns that covered them.
        able = state.able & ~dead & ~taken & (reach >= wanted)
        state = replace(state, taken=taken, able=able, bound=np.where(able, np.maximum(_key(place, reach), state.bound), FAR))
    out = [(i, names[p]["pattern"], names[p]["word"], names[p]["tier"], *chosen[p][1:]) for i, p in enumerate(_order(rows, chosen, place))]
    return spark.createDataFrame(out[:most], schema)


def _order(rows: DataFrame, chosen: dict[int, tuple], place: np.ndarray) -> list[int]:
    """The patterns as one at a time would take them: of those whose forerunners are all taken, the first. A pattern follows
    those that covered rows of its own in earlier rounds; patterns of one round share no row."""
    if not chosen:
        return []
    when = np.full(len(place), FAR)
    when[list(chosen)] = [r[0] for r in chosen.values()]
    shared = rows.sparkSession.sparkContext.broadcast(when)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        for batch in batches:
            lists = batch.column(0)
            at, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((shared.value[at], row))
            at, row = at[order], row[order]
            first = at[np.maximum.accumulate(np.where(np.append(True, row[1:] != row[:-1]), np.arange(len(row)), 0))] if len(row) else at
            later = (shared.value[at] < FAR) & (shared.value[first] < shared.value[at])
            pairs |= set(zip(at[later].tolist(), first[later].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["at", "after"])

    pairs = rows.select("at").mapInArrow(run, "at bigint, after bigint").distinct().collect()
    waits, frees = Counter(r["at"] for r in pairs), defaultdict(list)
    for r in pairs:
        frees[r["after"]].append(r["at"])
    ready, out = [(place[p], -chosen[p][1], p) for p in chosen if not waits[p]], []
    heapq.heapify(ready)
    while ready:
        p = heapq.heappop(ready)[2]
        out.append(p)
        for q in frees[p]:
            waits[q] -= 1
            if not waits[q]:
                heapq.heappush(ready, (place[q], -chosen[q][1], q))
    return out
