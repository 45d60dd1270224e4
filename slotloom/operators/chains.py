"""Assignment in order (E3): slots and occurrences, both by time, matched within a drift; most matches, then the least total
distance. Of equal assignments it is the one that has passed the fewest occurrences at every slot.

A track is cut in blocks of time. What a block must know of those before it is how many of the occurrences that may be
matched on both sides of its beginning (their padded time holds that instant) are passed: few, whatever the track's length.
A block's summary has the best value for each such state at its beginning and at its end; summaries of neighbouring blocks
merge by a (max, +) product, which is associative. So dense and long tracks are spread over all tasks: blocks are
summarised, summaries are merged ``FAN`` by ``FAN``, the states between blocks are read back from the top, and each block
finds its own matches between the states at its ends. Tracks of one block need none of that.

Slots: track_id, token_index, time_ms; occurrences: track_id, occ_index, word, start_ms, end_ms. Rows without time are left
out. An occurrence that holds many blocks is in each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.sources.scratch import cut

#: Length of a block, summaries merged at once.
BLOCK_MS, FAN = 600_000, 64
#: A match outweighs all distances of a block.
MATCH = 1 << 40
NEVER = -(1 << 60)
ANY = -1
#: Matches that leave a task at once.
TOGETHER = 8192


class Block:
    """One block: times of its slots in order, and starts and ends of the occurrences (by start) that its slots may meet."""

    def __init__(self, times: np.ndarray, starts: np.ndarray, ends: np.ndarray, drift: int, begin: int, end: int):
        self.times, self.starts, self.ends, self.drift = times, starts, ends, drift
        crossing = lambda at: np.flatnonzero((starts - drift < at) & (ends + drift >= at))
        self.before, self.after = crossing(begin), crossing(end)
        # The occurrences that a slot may match lie between these: ends need not rise, their running maximum does.
        self.low = np.searchsorted(np.maximum.accumulate(ends), times - drift, "left") if len(ends) else np.zeros(len(times), np.int64)
        self.high = np.searchsorted(starts, times + drift, "right")
        self.alone, self.rest = self._split()

    def _split(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots that share no occurrence with another slot nor with a state at an end of the block: their matches depend on
        nothing else, and what they add is the same for every state. The others, without those that meet none."""
        met = np.flatnonzero(self.low < self.high)
        low, high = self.low[met], self.high[met]
        # Both rise with time, so neighbours tell.
        apart = low[1:] >= high[:-1]
        alone = np.concatenate([[True], apart]) & np.concatenate([apart, [True]]) if len(met) else np.zeros(0, bool)
        if len(self.before):
            alone &= low > self.before[-1]
        if len(self.after):
            alone &= high <= self.after[0]
        return met[alone], met[~alone]

    def _nearest(self) -> list[tuple[int, int, int]]:
        """(slot, occurrence, distance) of the slots alone: the nearest within the drift, of equal ones the first."""
        if not len(self.alone):
            return []
        low, size = self.low[self.alone], (self.high - self.low)[self.alone]
        heads = np.cumsum(size) - size
        j, t = np.arange(size.sum()) + np.repeat(low - heads, size), np.repeat(self.times[self.alone], size)
        far = np.maximum(np.maximum(self.starts[j] - t, t - self.ends[j]), 0)
        best = np.minimum.reduceat((np.where(far <= self.drift, far, self.drift + 1) << 32) + j, heads)
        ok = best >> 32 <= self.drift
        return list(zip(self.alone[ok].tolist(), (best[ok] & 0xFFFFFFFF).tolist(), (best[ok] >> 32).tolist()))

    def _steps(self, best: np.ndarray, keep: list | None = None) -> np.ndarray:
        """best[s, j]: the value with occurrence j - 1 matched last (j = 0: none of the block), for each state s at the
        beginning; after all slots but those alone. keep: gets for each slot which matches are at least as good, and after which state."""
        reach, places = np.maximum.accumulate(best, 1), np.arange(best.shape[1])
        rises = lambda part: np.concatenate([np.zeros((len(part), 1), bool), part[:, 1:] > part[:, :-1]], 1)
        # The first place that has each running maximum.
        first = np.maximum.accumulate(np.where(rises(reach), places, 0), 1)
        top = int(self.before[-1]) + 1 if len(self.before) else 0
        for t, lo, hi in zip(*(x[self.rest].tolist() for x in (self.times, self.low, self.high))):
            if hi > top:  # nothing beyond has been matched yet
                reach[:, top + 1 : hi + 1], first[:, top + 1 : hi + 1], top = reach[:, top : top + 1], first[:, top : top + 1], hi
            far = np.maximum(np.maximum(self.starts[lo:hi] - t, t - self.ends[lo:hi]), 0)
            gain = reach[:, lo:hi] + np.where(far <= self.drift, MATCH - far, NEVER)
            if keep is not None:
                keep.append((lo, hi, (gain >= best[:, lo + 1 : hi + 1])[0] & (far <= self.drift) & (reach[0, lo:hi] > NEVER // 2), first[0, lo:hi].copy(), far))
            best[:, lo + 1 : hi + 1] = np.maximum(best[:, lo + 1 : hi + 1], gain)
            part = np.maximum.accumulate(np.concatenate([reach[:, lo : lo + 1], best[:, lo + 1 : hi + 1]], 1), 1)
            reach[:, lo : hi + 1] = part
            if keep is not None:
                first[:, lo : hi + 1] = np.maximum(np.maximum.accumulate(np.where(rises(part), places[lo : hi + 1], 0), 1), first[:, lo : lo + 1])
        return best

    def _start(self, states: list[int]) -> np.ndarray:
        best = np.full((len(states), len(self.starts) + 1), NEVER)
        for row, s in enumerate(states):
            best[row, self.before[s - 1] + 1 if s else 0] = 0
        return best

    def _ends(self) -> np.ndarray:
        """The state at the end for each occurrence matched last."""
        return np.searchsorted(self.after, np.arange(len(self.starts) + 1), "left")

    def summary(self) -> np.ndarray:
        """The best value for each state at the beginning (rows) and at the end."""
        best = self._steps(self._start(list(range(len(self.before) + 1))))
        out = np.full((len(best), len(self.after) + 1), NEVER)
        state = self._ends()
        for s in range(out.shape[1]):
            own = best[:, state == s]
            out[:, s] = own.max(1) if own.shape[1] else NEVER
        return out

    def matches(self, state: int, until: int) -> list[tuple[int, int, int]]:
        """(slot, occurrence, distance) between two states, ``until`` = ANY: the best."""
        keep: list = []
        if not len(self.rest):
            return self._nearest()
        best = self._steps(self._start([state]), keep)[0]
        if until != ANY:
            best = np.where(self._ends() == until, best, NEVER)
        j, out = int(best.argmax()), []
        for i, (lo, hi, took, before, far) in zip(self.rest[::-1].tolist(), keep[::-1]):
            if lo < j <= hi and took[j - 1 - lo]:
                out.append((i, j - 1, int(far[j - 1 - lo])))
                j = int(before[j - 1 - lo])
        return sorted(out + self._nearest())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two summaries as one; values count from the best, so that they never grow with the track."""
    out = (a[:, :, None] + b[None]).max(1)
    return np.where(out > NEVER // 2, out - out.max(), NEVER)


def states_between(parts: list[np.ndarray], state: int, until: int) -> list[int]:
    """The states before each part and after the last one: the lowest of those with the best value."""
    values = [np.where(np.arange(parts[0].shape[0]) == state, 0, NEVER)]
    for m in parts:
        v = (values[-1][:, None] + m).max(0)
        values.append(np.where(v > NEVER // 2, v - v.max(), NEVER))
    out = [int(values[-1].argmax()) if until == ANY else until]
    for v, m in zip(values[-2::-1], parts[::-1]):
        out.append(int((v + m[:, out[-1]]).argmax()))
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first columns; rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() for c in batch.columns[:keys]]
        key = list(zip(*columns))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


KEYS = ["drift", "track_id", "block"]


def _block(rows: pa.Table, width: int, begin: int) -> tuple[Block, pa.Table, pa.Table]:
    """A block from its rows, which come by side, time and number; and its slots and occurrences."""
    first = pc.index(rows["side"], "s").as_py()  # occurrences come before
    first = len(rows) if first < 0 else first
    slots, occurrences = rows.slice(first), rows.slice(0, first)
    a, b = (rows[c].to_numpy().astype(np.int64) for c in ("a", "b"))
    return Block(a[first:], a[:first], b[:first], rows["drift"][0].as_py(), begin, begin + width), slots, occurrences


def _dealt(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition(*KEYS).sortWithinPartitions(*KEYS, *more)


def _summaries(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """drift, track_id, block, wide (states at the beginning) and values of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            m = _block(group, width, group["origin"][0].as_py() + group["block"][0].as_py() * width)[0].summary()
            yield pa.RecordBatch.from_arrays([*(group[k].combine_chunks().slice(0, 1) for k in KEYS), pa.array([m.shape[0]], pa.int32()), pa.array([m.tobytes()], pa.binary())], [*KEYS, "wide", "values"])

    return _dealt(rows, "side", "a", "k").select(*KEYS, "side", "a", "b", "k", "origin").mapInArrow(run, f"drift int, track_id {kind}, block bigint, wide int, values binary")


def _matrices(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(v, np.int64).reshape(w, -1) for w, v in zip(group["wide"].to_pylist(), group["values"].to_pylist())]


def _merged(level: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            parts = _matrices(group)
            m = parts[0]
            for p in parts[1:]:
                m = product(m, p)
            yield pa.RecordBatch.from_arrays([*(group[k].combine_chunks().slice(0, 1) for k in KEYS), pa.array([m.shape[0]], pa.int32()), pa.array([m.tobytes()], pa.binary())], [*KEYS, "wide", "values"])

    up = level.select("drift", "track_id", F.floor(F.col("block") / FAN).cast("bigint").alias("block"), F.col("block").alias("k"), "wide", "values")
    return _dealt(up, "k").mapInArrow(run, f"drift int, track_id {kind}, block bigint, wide int, values binary")


def _states(level: DataFrame, above: DataFrame | None, kind: str) -> DataFrame:
    """drift, track_id, block, state and until of each block of a level, from those of the level above (none: free)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            state, until = group["state"][0].as_py(), group["until"][0].as_py()
            found = states_between(_matrices(group), state or 0, ANY if until is None else until)
            n = len(group)
            yield pa.RecordBatch.from_arrays([group["drift"].combine_chunks(), group["track_id"].combine_chunks(), group["k"].combine_chunks(), pa.array(found[:n], pa.int32()), pa.array(found[1:], pa.int32())], [*KEYS, "state", "until"])

    own = level.select("drift", "track_id", F.floor(F.col("block") / FAN).cast("bigint").alias("block"), F.col("block").alias("k"), "wide", "values")
    free = [F.lit(None).cast("int").alias(c) for c in ("state", "until")]
    own = own.join(above.select(*KEYS, "state", "until"), KEYS) if above is not None else own.select("*", *free)
    return _dealt(own, "k").mapInArrow(run, f"drift int, track_id {kind}, block bigint, state int, until int")


def _blocks(slots: DataFrame, occurrences: DataFrame, drifts_ms: tuple[int, ...], width: int) -> DataFrame:
    """Both sides once for each drift, dealt to blocks that count from the track's first instant."""
    drift, pad = F.explode(F.array(*[F.lit(d).cast("int") for d in drifts_ms])).alias("drift"), max(drifts_ms)
    s = slots.where("time_ms IS NOT NULL").select("track_id", F.lit("s").alias("side"), F.col("time_ms").cast("bigint").alias("a"), F.col("time_ms").cast("bigint").alias("b"), F.col("token_index").cast("bigint").alias("k"), F.lit(None).cast("string").alias("word"))
    o = occurrences.where("start_ms IS NOT NULL AND end_ms IS NOT NULL").select("track_id", F.lit("o").alias("side"), F.col("start_ms").cast("bigint").alias("a"), F.col("end_ms").cast("bigint").alias("b"), F.col("occ_index").cast("bigint").alias("k"), "word")
    both = cut(s.unionByName(o), "sides")
    spans = both.groupBy("track_id").agg(F.min(F.when(F.col("side") == "s", F.col("a"))).alias("origin"), F.max(F.when(F.col("side") == "s", F.col("a"))).alias("last")).where("origin IS NOT NULL")
    spans = spans.select("track_id", "origin", F.floor((F.col("last") - F.col("origin")) / width).cast("bigint").alias("blocks"))
    # Occurrences before the first and after the last block meet no slot.
    at = lambda t: F.floor((t - F.col("origin")) / width).cast("bigint")
    pads = F.when(F.col("side") == "o", F.lit(pad)).otherwise(0)
    held = both.join(spans, "track_id").withColumn("lo", F.greatest(at(F.col("a") - pads), F.lit(0))).withColumn("hi", F.least(at(F.col("b") + pads), F.col("blocks"))).where("lo <= hi")
    return held.select("track_id", "side", "a", "b", "k", "word", "origin", "blocks", drift, "lo", "hi").select("*", F.explode(F.sequence("lo", "hi")).alias("block")).drop("lo", "hi")


def align_drifts(slots: DataFrame, occurrences: DataFrame, drifts_ms: tuple[int, ...], width: int = BLOCK_MS) -> DataFrame:
    """E3 for several drifts in one job: drift, track_id, token_index, occ_index, word, distance_ms."""
    kind = slots.schema["track_id"].dataType.simpleString()
    rows = cut(_blocks(slots, occurrences, drifts_ms, width), "blocks")
    most = rows.agg(F.max("blocks")).first()[0]
    ends = None
    if most:
        levels = [cut(_summaries(rows.where("blocks > 0"), width, kind), "summaries")]
        while most >= FAN:
            levels.append(cut(_merged(levels[-1], kind), "summaries"))
            most //= FAN
        for level in reversed(levels):
            ends = _states(level, ends, kind)
            ends = cut(ends, "states")

    names = ["drift", "track_id", "token_index", "occ_index", "word", "distance_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, n = [], 0
        for group in _groups(batches, 3):
            block, s, o = _block(group, width, group["origin"][0].as_py() + group["block"][0].as_py() * width)
            if not len(s) or not len(o):
                continue
            state, until = group["state"][0].as_py(), group["until"][0].as_py()
            found = block.matches(state or 0, ANY if until is None else until)
            if not found:
                continue
            i, j, far = np.array(found, np.int64).T
            take = lambda t, c, at: t[c].combine_chunks().take(at)
            own, met = pa.array(i), pa.array(j)
            done.append(pa.RecordBatch.from_arrays([take(s, "drift", own), take(s, "track_id", own), take(s, "k", own), take(o, "k", met), take(o, "word", met), pa.array(far)], names))
            n += len(i)
            # blocks of few matches leave together, not as a batch each
            if n >= TOGETHER:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done, n = [], 0
        if n:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    held = rows.join(ends, KEYS, "left") if ends is not None else rows.select("*", F.lit(None).cast("int").alias("state"), F.lit(None).cast("int").alias("until"))
    dealt = _dealt(held, "side", "a", "k").select(*KEYS, "side", "a", "b", "k", "word", "origin", "state", "until")
    return dealt.mapInArrow(run, f"drift int, track_id {kind}, token_index bigint, occ_index bigint, word string, distance_ms bigint")
