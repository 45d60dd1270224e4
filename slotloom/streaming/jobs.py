"""Streaming jobs. Each transformation also runs on batch tables, where it gives the stream's final result."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slotloom.functions import text as T
from slotloom.operators.slots import speech_windows
from slotloom.sources import versions

PRIORITY = {"confirmed": 3, "rule": 2, "context": 2, "media": 1}


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream over Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_slots(events: DataFrame) -> DataFrame:
    """K1: slots of arriving events (ts, track_id, event_index, text), one row a slot."""
    parts = F.split(T.normalize_mask("text"), r"\[__\]", -1)
    rows = events.select("ts", "track_id", "event_index", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("slot_in_event", "before"))
    return rows.select("ts", "track_id", "event_index", "slot_in_event", T.context_key("before").alias("preceding"))


def slot_key() -> Column:
    return F.sha2(F.concat_ws("\u0000", F.col("track_id").cast("string"), F.col("event_index").cast("string"), F.col("slot_in_event").cast("string"), "preceding"), 256)


def stream_dedup(slots: DataFrame, late: str = "1 hour") -> DataFrame:
    """K2: each slot once within the watermark."""
    keyed = slots.withColumn("slot_key", slot_key())
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["slot_key"]) if slots.isStreaming else keyed.dropDuplicates(["slot_key"])


def stream_join_segments(slots: DataFrame, segments: DataFrame, late: str = "1 hour", before_s: int = 3, after_s: float = 1.5, longest: str | None = None) -> DataFrame:
    """K3: a slot (ts, track_id, slot_id) with the segment (start_ts, end_ts) of its track that covers [t - 3, t + 1.5].
    longest: how long segments may be, an interval; it lets a stream drop old state and has no effect on tables."""
    a, b = slots, segments.withColumnRenamed("track_id", "seg_track")
    if slots.isStreaming:
        a, b = a.withWatermark("ts", late), b.withWatermark("start_ts", late)
    ms = F.expr(f"INTERVAL '{before_s}' SECOND"), F.expr(f"INTERVAL '{after_s}' SECOND")
    inside = (F.col("track_id") == F.col("seg_track")) & (F.col("start_ts") <= F.col("ts") - ms[0]) & (F.col("end_ts") >= F.col("ts") + ms[1])
    if slots.isStreaming and longest:
        inside = inside & (F.col("start_ts") >= F.col("ts") - F.expr(f"INTERVAL {longest}"))
    return a.join(b, inside).drop("seg_track")


def priority(source: str = "source") -> Column:
    return F.coalesce(*[F.when(F.col(source) == k, v) for k, v in PRIORITY.items()], F.lit(0))


def resolve_batch(rows: DataFrame) -> DataFrame:
    """K4 on a table: each slot's resolution of the highest priority; of equal ones the last (seq)."""
    return rows.groupBy("slot_id").agg(F.max_by(F.struct("word", "source"), F.struct(priority().alias("p"), "seq")).alias("best")).select("slot_id", "best.word", "best.source")


class Lasting(StatefulProcessor):
    """State that ends: with event times (``ts``), each row keeps its key's state for ``keep_ms`` more, and a timer clears it
    when the watermark has passed that. Subclasses make their states in ``open`` and clear them in ``forget``."""

    def __init__(self, timed: bool, keep_ms: int):
        self.timed, self.keep_ms = timed, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "at bigint")
        self.open(handle)

    def lasts(self, frame: pd.DataFrame) -> None:
        if self.timed:
            at = int(frame["ts"].max().timestamp() * 1000) + self.keep_ms
            if not self.until.exists() or self.until.get()[0] < at:
                self.until.update((at,))
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A key that has been seen since has a later timer.
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            self.forget()
        return iter(())

    def close(self) -> None:
        pass


def _with_state(rows: DataFrame, key: str, make: Callable[[bool, int], Lasting], schema: str, mode: str, late: str | None, keep_ms: int) -> DataFrame:
    """Rows of a stream by key through a processor; late: how far the watermark stays behind ``ts`` (none: no end of state).
    Sets the session's state store to the one that such processors need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = late is not None
    rows = rows.withWatermark("ts", late) if timed else rows
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(make(timed, keep_ms), f"{key} {kind}, {schema}", mode, "EventTime" if timed else "None")


HOUR_MS = 3_600_000


class Best(Lasting):
    """K4: a slot's best resolution so far."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "p int, seq bigint, word string, source string")

    def forget(self) -> None:
        self.best.clear()

    def handleInputRows(self, key, frames, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(frames))
        self.lasts(came)
        came["p"] = came["source"].map(PRIORITY).fillna(0).astype(int)
        first = came.sort_values(["p", "seq"], kind="stable").iloc[-1]
        new = (int(first["p"]), int(first["seq"]))
        held = self.best.get() if self.best.exists() else None
        if held is None or new > (held[0], held[1]):
            word, source = (None if pd.isna(first[c]) else first[c] for c in ("word", "source"))
            self.best.update((*new, word, source))
            yield pd.DataFrame({"slot_id": [key[0]], "word": [word], "source": [source], "seq": [new[1]]})


def resolve_state(rows: DataFrame, late: str | None = None, keep_ms: int = HOUR_MS) -> DataFrame:
    """K4 on a stream (slot_id, seq, word, source; ts where ``late`` is given): the state keeps the best so far; each change
    goes out."""
    return _with_state(rows, "slot_id", Best, "word string, source string, seq bigint", "update", late, keep_ms)


def _fill_kinds(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """What an event does to its slot: ``set`` (an allowed word), ``clear`` (an empty media fill), ``veto`` (a rule's word
    that is not allowed: it clears a media fill); others do nothing and leave."""
    known = rows.join(lexicon.select(F.lower("word").alias("__w"), F.lit(True).alias("__ok")).dropDuplicates(["__w"]), F.lower("word") == F.col("__w"), "left")
    empty = F.coalesce(F.trim("word"), F.lit("")) == ""
    kind = F.when(empty & (F.col("source") == "media"), "clear").when(F.col("__ok"), "set").when(F.col("source").isin("rule", "context"), "veto")
    return known.withColumn("kind", kind).drop("__w", "__ok").where("kind IS NOT NULL")


def fill_cache(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """K4b on a table (slot_id, seq, word, source): each slot's accepted fill. An empty media fill deletes, and so does a
    rule's word after a media fill unless that word is allowed and takes its place."""
    last = F.max_by(F.struct("kind", "word", "source", "seq"), F.when(F.col("kind") != "veto", F.col("seq"))).alias("last")
    held = _fill_kinds(rows, lexicon).groupBy("slot_id").agg(last, F.max(F.when(F.col("kind") == "veto", F.col("seq"))).alias("veto"))
    gone = (F.col("last.source") == "media") & F.coalesce(F.col("veto") > F.col("last.seq"), F.lit(False))
    return held.where((F.col("last.kind") == "set") & ~gone).select("slot_id", "last.word", "last.source")


def _frames(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """One key's rows of one batch in order."""
    return pd.concat(list(frames)).sort_values(list(order), kind="stable")


class Fill(Lasting):
    """A slot's accepted fill."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.fill = handle.getValueState("fill", "word string, source string")

    def forget(self) -> None:
        self.fill.clear()

    def handleInputRows(self, key, frames, timerValues) -> Iterator[pd.DataFrame]:
        came = _frames(frames, "seq")
        self.lasts(came)
        before = word, source = tuple(self.fill.get()) if self.fill.exists() else (None, None)
        for kind, new, origin in zip(came["kind"], came["word"], came["source"]):
            if kind == "set":
                word, source = new, origin
            elif kind == "clear" or source == "media":
                word, source = None, None
        if (word, source) != before:
            self.fill.update((word, source)) if word is not None else self.fill.clear()
            yield pd.DataFrame({"slot_id": [key[0]], "word": [word], "source": [source], "seq": [int(came["seq"].iloc[-1])]})


def fill_cache_state(rows: DataFrame, lexicon: DataFrame, late: str | None = None, keep_ms: int = HOUR_MS) -> DataFrame:
    """K4b on a stream: the state is the slot's fill, if it has one; each change goes out, a null word for a deletion."""
    return _with_state(_fill_kinds(rows, lexicon), "slot_id", Fill, "word string, source string, seq bigint", "update", late, keep_ms)


def invalidate_generation(rows: DataFrame) -> DataFrame:
    """K5: rows (session, track_id, generation, slot_id, seq) of the latest generation of each session and track; within
    it each slot's last row."""
    w = Window.partitionBy("session", "track_id")
    now = rows.withColumn("latest", F.max("generation").over(w)).where("generation = latest").drop("latest")
    return now.withColumn("k", F.row_number().over(Window.partitionBy("session", "track_id", "slot_id").orderBy(F.desc("seq")))).where("k = 1").drop("k")


class Generation(Lasting):
    """K5: a session's track and generation, and a map of the slots it holds. A batch of the same generation touches only its
    own slots; the others are read when a new generation retires them."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "track_id bigint, generation bigint")
        self.slots = handle.getMapState("slots", "slot_id bigint", "seq bigint")

    def forget(self) -> None:
        self.now.clear()
        self.slots.clear()

    def handleInputRows(self, key, frames, timerValues) -> Iterator[pd.DataFrame]:
        came = _frames(frames, "seq")
        self.lasts(came)
        came = came[came["generation"] >= came["generation"].cummax()]
        track, generation = self.now.get() if self.now.exists() else (None, None)
        for number, part in came.groupby("generation"):
            if generation is not None and number < generation:
                continue
            for new, rows_ in part.groupby("track_id", sort=False):
                new, seq = int(new), int(rows_["seq"].max())
                if number != generation or new != track:
                    held = sorted(k[0] for k in self.slots.keys()) if self.slots.exists() else []
                    stay = set(rows_["slot_id"]) if new == track else set()
                    gone = [s for s in held if s not in stay]
                    if gone:
                        yield pd.DataFrame({"session": key[0], "track_id": track, "generation": generation, "slot_id": gone, "seq": seq, "action": "retire"})
                    self.slots.clear()
                    track, generation = new, int(number)
                    self.now.update((track, generation))
                for s, q in zip(rows_["slot_id"], rows_["seq"]):
                    self.slots.updateValue((int(s),), (int(q),))
                yield pd.DataFrame({"session": key[0], "track_id": new, "generation": int(number), "slot_id": rows_["slot_id"].to_numpy(), "seq": rows_["seq"].to_numpy(), "action": "publish"})


def generation_state(rows: DataFrame, late: str | None = None, keep_ms: int = HOUR_MS) -> DataFrame:
    """K5 on a stream, by session: rows of an older generation are dropped, others published (``action``). A new
    generation of another track retires all slots held; one of the same track those that its first batch does not bring."""
    return _with_state(rows, "session", Generation, "track_id bigint, generation bigint, slot_id bigint, seq bigint, action string", "append", late, keep_ms)


def late_slots(slots: DataFrame, playhead: str = "playhead_s", time: str = "time_s", most: float = 1.0) -> DataFrame:
    """K6: slots marked late when more than a second behind the playhead; they stay pending."""
    return slots.withColumn("late", F.col(playhead) - F.col(time) > most)


def late_sinks(slots: DataFrame, live: str, side: str, checkpoint: str):
    """K6 as one stream with two sinks: slots that the playhead has not passed go to the table at ``live``, passed ones to
    that at ``side``, where they stay pending. A batch writes a folder of its own in each, and writes over it when it runs
    again, so no slot comes twice or is lost."""

    def split(df: DataFrame, batch: int) -> None:
        marked = late_slots(df)
        for late, path in ((False, live), (True, side)):
            own = marked.where(F.coalesce("late", F.lit(False)) == late).drop("late")
            own.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return slots.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).start()


def after_seek(spark: SparkSession, side: str, seeks: DataFrame, most: float = 1.0) -> DataFrame:
    """K6: the slots of the side table that are ahead again once their track's playhead has moved back, once each. seeks:
    track_id, playhead_s."""
    held = spark.read.parquet(side).drop("playhead_s", "batch")
    now = late_slots(held.join(seeks.select("track_id", "playhead_s"), "track_id"), most=most)
    return now.where("NOT late").drop("late").dropDuplicates(["track_id", "slot_id"])


def window_groups(rows: DataFrame, gap: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    """K7: sessions of arriving slots by track: a new one after a gap."""
    source = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return source.groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("track_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def pack_windows(slots: DataFrame, before: float = 3.0, after: float = 1.5, most: float = 30.0) -> DataFrame:
    """K7: C12's windows of slots (track_id, token_index, time_s). On a stream the state is each track's open window; slots
    come in the order of time, within a batch they are put in it."""
    if not slots.isStreaming:
        return speech_windows(slots, before, after, most)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, opens = state.get if state.exists else (-1, 0.0)
        out = []
        for token, time in _frames(frames, "time_s", "token_index")[["token_index", "time_s"]].itertuples(index=False):
            if number < 0 or time + after > opens + most:
                number, opens = number + 1, time - before
            out.append((key[0], token, number, opens))
        state.update((number, opens))
        yield pd.DataFrame(out, columns=["track_id", "token_index", "window_no", "opens"])

    track, token = (slots.schema[c].dataType.simpleString() for c in ("track_id", "token_index"))
    return slots.groupBy("track_id").applyInPandasWithState(update, f"track_id {track}, token_index {token}, window_no int, opens double", "number int, opens double", "append", GroupStateTimeout.NoTimeout)


# The seconds that a window and each of its slots may take.
WINDOW_SECONDS, SLOT_SECONDS = 0.74, 0.64


def speed_monitor(rows: DataFrame, last: int = 15, least: int = 5) -> DataFrame:
    """K8: by device after each sample (seq, seconds, slots) the upper median of the last ratios of seconds to the seconds
    allowed, and whether the device is fast enough."""
    w = Window.partitionBy("device").orderBy("seq").rowsBetween(-(last - 1), 0)
    rated = rows.withColumn("ratio", F.col("seconds") / (WINDOW_SECONDS + SLOT_SECONDS * F.col("slots")))
    held = rated.withColumn("held", F.sort_array(F.collect_list("ratio").over(w)))
    median = F.get("held", F.floor(F.size("held") / 2).cast("int"))
    return held.select("device", "seq", median.alias("median"), ((F.size("held") >= least) & (median <= 1)).alias("fast"))


class Speed(Lasting):
    """K8: a device's last ratios."""

    last, least = 15, 5

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ratios array<double>")

    def forget(self) -> None:
        self.held.clear()

    def handleInputRows(self, key, frames, timerValues) -> Iterator[pd.DataFrame]:
        came = _frames(frames, "seq")
        self.lasts(came)
        old = [float(x) for x in self.held.get()[0]] if self.held.exists() else []
        ratios = [*old, *(came["seconds"] / (WINDOW_SECONDS + SLOT_SECONDS * came["slots"])).tolist()]
        ends = range(len(old) + 1, len(ratios) + 1)
        windows = [sorted(ratios[max(0, e - self.last) : e]) for e in ends]
        medians = [w[len(w) // 2] for w in windows]
        self.held.update((ratios[-self.last :],))
        yield pd.DataFrame({"device": key[0], "seq": came["seq"].to_numpy(), "median": medians, "fast": [len(w) >= self.least and m <= 1 for w, m in zip(windows, medians)]})


def speed_state(rows: DataFrame, last: int = 15, least: int = 5, late: str | None = None, keep_ms: int = 24 * HOUR_MS) -> DataFrame:
    """K8 on a stream: the state is the device's last ratios."""

    def make(timed: bool, keep: int) -> Speed:
        processor = Speed(timed, keep)
        processor.last, processor.least = last, least
        return processor

    return _with_state(rows, "device", make, "seq bigint, median double, fast boolean", "append", late, keep_ms)


def incremental_refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """K9: rows of sources whose hash is unchanged are kept, the others rebuilt; a source that lost rows stays as it was.
    old, new: source, source_hash, row_id; ``origin`` tells."""
    count = lambda df, n, h: df.groupBy("source").agg(F.count("*").alias(n), F.max("source_hash").alias(h))
    plan = count(old, "old_n", "old_hash").join(count(new, "new_n", "new_hash"), "source", "full_outer")
    keep = F.col("new_n").isNull() | (F.col("new_hash") == F.col("old_hash")) | (F.col("new_n") < F.col("old_n"))
    plan = plan.select("source", F.coalesce(F.col("old_n").isNotNull() & keep, F.lit(False)).alias("keep"))
    a = old.join(plan.where("keep"), "source").withColumn("origin", F.lit("reused"))
    b = new.join(plan.where("NOT keep"), "source").withColumn("origin", F.lit("rebuilt"))
    return a.unionByName(b).drop("keep")


def refresh_batches(stream: DataFrame, path: str, checkpoint: str):
    """K9 as a stream (source, source_hash, row_id and more): a micro-batch writes the sources it changes and a manifest by
    source, whatever the size of the rest; sources that it does not bring stay; a source that comes with fewer rows stays
    as it was. A batch that runs again after a failure finds its sources unchanged and adds nothing."""

    def merge(df: DataFrame, _: int) -> None:
        versions.refresh(df, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def windowed_counts(rows: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by kind over tumbling or sliding windows."""
    source = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return source.groupBy(F.window("ts", length, slide).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into a table in memory (for small results) and returns it."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
