"""Near copies by the Jaccard coefficient of word shingles, beside the fingerprint links of ``simhash``.

Words and their lower case are those of ``simhash``; a shingle is ``width`` words (all words, if fewer). Texts with the
same set of shingles are one class and go on once. Two classes are candidates when they agree on all minima of a band:
at a Jaccard of 0.8, 32 bands of 4 miss a pair with a chance of 5e-8, and fewer above. Every candidate is verified on the
sets. Sets and classes are told apart by 64-bit hashes.

A band key that more than ``paired`` classes share makes no pairs. Each of its classes is verified against the least one;
the classes of keys that are not one component by then meet by an exact prefix filter instead. Their shingles are put in
one order, rarest first (by counts of a fixed number of buckets; any order is right). Two sets of a Jaccard of t share a
shingle among the first n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller one, so
only these are joined, and only across components. Where the first shared one is the i-th of a set, at most n - i are
shared, so the two sizes and places must leave room for the shared part that the pair needs. A passage that very many
texts share is frequent and thus last in order: it makes no pairs unless it is most of both texts. Keys that over
``paired`` rows hold are dealt by classes of size: a row only goes to the classes of partners that its place leaves room
for, so rows that a passage cannot make alike do not even meet. Within the join a map of MARKS parities of each set's
shingles tells the least number in which two sets differ, so pairs that are clearly too far apart do not leave it.

Null, empty and blank texts have no shingle: their fingerprint is zero, linked like any other. Rows are told apart by id
and text: rows that repeat both are one class anyway, rows with one id and different texts are documents of their own.
Null ids are linked too and come last when a component is named. Very long texts are read whole, a chunk of their own.
An empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.decontam import _shingles
from slotloom.llm.graph import components
from slotloom.llm.simhash import _LOWER, PAIRED, fingerprint, links
from slotloom.llm.store import cut, join_unique
from slotloom.llm.wordstream import Stream, chunks

WIDTH, LEAST, BANDS, ROWS = 5, 0.8, 32, 4
#: Counters that tell frequent shingles; their number does not grow with the texts.
BUCKETS = 1 << 20
#: Ratio of neighbouring classes of size.
STEP = 1.05
#: Bits of a set's parity map, a multiple of 64.
MARKS = 512
#: Rows of keys (24 bytes each) up to which they are broadcast.
BROADCAST = 1 << 20
#: Shared band keys (24 bytes each) up to which they are broadcast.
KEYS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(44)).astype(np.int64)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within each; offsets of each text's part)."""
    stream = Stream([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass") for t in texts])
    begin, end = stream.runs(~((stream.codes == 32) | ((stream.codes >= 9) & (stream.codes <= 13))))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    keys, at = stream.keys(begin, end), stream.per_text(begin)
    words = np.diff(at)
    parts = [_shingles(keys, at, width)]
    for k in range(1, width):
        h, owner = _shingles(keys, at, k)
        parts.append((h[words[owner] == k], owner[words[owner] == k]))
    h, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def class_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set; 0 for the empty one."""
    x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]]


def band_keys(h: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys (sets x bands) of the minima of ``rows`` hash functions each. No set may be empty."""
    flips, factors = _constants(bands * rows)
    out = np.zeros((len(at) - 1, bands), np.uint64)
    for i in range(bands * rows):
        key = (out[:, i // rows] ^ np.minimum.reduceat((h ^ flips[i]) * factors[i], at[:-1])) * _MIX
        out[:, i // rows] = key ^ (key >> _SHIFT)
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int, fp_width: int) -> DataFrame:
    """id, hash (of the text), fp, cls, n (distinct shingles) and bands (none for a text without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                h, at = shingle_sets(texts[lo:hi], width)
                n = np.diff(at)
                some = np.flatnonzero(n)
                bands: list = [None] * (hi - lo)
                if len(some):
                    for i, row in zip(some.tolist(), band_keys(h, np.append(at[some], len(h))).view(np.int64)):
                        bands[i] = row
                fps = np.fromiter((fingerprint(t, fp_width) for t in texts[lo:hi]), np.uint64, hi - lo)
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(fps.view(np.int64)), pa.array(class_keys(h, at).view(np.int64)), pa.array(n.astype(np.int32)), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "fp", "cls", "n", "bands"])

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, hash bigint, fp bigint, cls bigint, n int, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """cls and shingles (sorted hashes as bytes) of the wanted classes, each read off one text. wanted: id, hash, cls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for lo, hi in chunks(texts):
                h, at = shingle_sets(texts[lo:hi], width)
                same = np.flatnonzero(class_keys(h, at).view(np.int64) == own[lo:hi]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own[lo:hi][same]), pa.array([h[at[i] : at[i + 1]].tobytes() for i in same], pa.binary())], ["cls", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["hash"] == wanted["hash"])).select("cls", "text")
    # a repeated id may stand for several texts, and several rows for one class
    return texts.mapInArrow(run, "cls bigint, shingles binary").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    held = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, n: str, at: str, least: float, larger: bool) -> DataFrame:
    """Rows with c1 and c2, the classes of size of the larger and the smaller set of a pair, for all partners for which a
    set of ``n`` shingles, the first shared one at place ``at``, leaves room. larger: whether the rows' own set is it."""
    size_class = lambda x: F.floor(F.log(F.greatest(x, F.lit(1.0))) / np.log(STEP)).cast("int")
    room = (F.col(n) - F.col(at)) * ((1 + least) / least) - F.col(n) + 1e-6
    lo, hi = (least * F.col(n) - 1e-6, F.least(F.col(n) + 1e-6, room)) if larger else (F.col(n) - 1e-6, F.least(F.col(n) / least + 1e-6, room))
    fits = rows.where(lo <= hi).withColumn("own", size_class(F.col(n).cast("double"))).withColumn("other", F.explode(F.sequence(size_class(lo), size_class(hi))))
    return fits.withColumnsRenamed({"own": "c1", "other": "c2"} if larger else {"own": "c2", "other": "c1"})


def _across(rows: DataFrame, least: float, paired: int = PAIRED) -> DataFrame:
    """Pairs (a, b) of classes of different roots that may have a Jaccard of ``least``, by prefixes of the rarest shingles.
    rows: cls, root, shingles."""
    spark = rows.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, _bucket(np.frombuffer(x.as_buffer(), "<u8")), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    counts = rows.select("shingles").mapInArrow(tally, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            keys, owner, size, place, short, marks = [], [], [], [], [], np.zeros((batch.num_rows, MARKS // 64), np.int64)
            for i, x in enumerate(batch.column(2)):
                h = np.frombuffer(x.as_buffer(), "<u8")
                n = len(h)
                longer, shorter = n - int(np.ceil(least * n - 1e-9)) + 1, n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1
                odd = np.bincount(((h ^ (h >> _SHIFT)) % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
                marks[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                first = h[np.lexsort((h, often[_bucket(h)]))[:longer]]
                keys.append(first)
                owner.append(np.full(len(first), i))
                size.append(np.full(len(first), n, np.int32))
                place.append(np.arange(len(first), dtype=np.int32))
                short.append(place[-1] < shorter)
            if keys:
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(size)), pa.array(np.concatenate(place)), pa.array(np.concatenate(short)), *(pa.array(m[np.concatenate(owner)]) for m in marks.T)], ["key", "cls", "root", "n", "place", "short", *names])

    names = [f"m{i}" for i in range(MARKS // 64)]
    own = cut(rows.select("cls", "root", "shingles").mapInArrow(prefixes, "key bigint, cls bigint, root bigint, n int, place int, short boolean, " + ", ".join(f"{m} bigint" for m in names)), "prefixes")
    # Keys whose classes are all of one root make no pair.
    split = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", "m")
    own = own.join(split, "key")
    small = own.where("short").select("key", "m", F.col("cls").alias("b"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("place").alias("place2"), *(F.col(m).alias(f"o{m}") for m in names))
    few = own.where(F.col("m") <= paired).join(small.where(F.col("m") <= paired).drop("m"), "key")
    crowded = _dealt(own.where(F.col("m") > paired), "n", "place", least, True).join(_dealt(small.where(F.col("m") > paired).drop("m"), "n2", "place2", least, False), ["key", "c1", "c2"]).drop("c1", "c2")
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"o{m}"))) for m in names), F.lit(0))
    both = F.col("n") + F.col("n2")
    # A Jaccard of t leaves at most (1 - t) / (1 + t) of both sizes to differ, and needs t / (1 + t) of them shared.
    near = differ <= (1 - least) / (1 + least) * both + 1e-9
    room = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= least / (1 + least) * both - 1e-6
    ordered = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("b") < F.col("cls")))
    held = few.unionByName(crowded).where("root <> root2").where(ordered).where(F.col("n2") >= least * F.col("n") - 1e-9).where(room).where(near)
    return held.select(F.greatest("cls", "b").alias("a"), F.least("cls", "b").alias("b")).distinct()


def _of_keys(many: DataFrame, one: DataFrame, counts: DataFrame, most: int = KEYS) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has each key ``at`` once (counts: at and n, its rows in ``many``). Up to
    ``most`` keys are broadcast, so rows of other keys are left out where they are; beyond that all rows are dealt out."""
    if one.count() <= most:
        return many.join(F.broadcast(one), "at")
    return join_unique(many, one, "at", counts, many.count())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, paired: int = PAIRED, fp_width: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """id, hash (xxhash64 of the text), times (rows that have both), component (struct of nameless, id and hash: the least
    of the component) of every distinct (id, text), over links of fingerprints within ``distance`` bits and of shingle
    sets with a Jaccard of ``least`` or more."""
    rows = cut(_signatures(docs, id_col, text_col, width, fp_width), "signatures")
    members = cut(rows.groupBy("id", "hash", "fp", "cls").agg(F.count("*").alias("times")), "members")
    name = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("hash"))
    classes = cut(members.groupBy("fp", "cls").agg(F.min(name).alias("least"), F.count("*").alias("n")), "classes")
    # Fingerprints go by the least class that has them.
    owner = classes.groupBy("fp").agg(F.min("cls").alias("own"))
    by_fp = links(owner.select("fp"), distance, blocks)
    ends = by_fp.join(owner.select(F.col("fp").alias("a"), F.col("own").alias("u")), "a").join(owner.select(F.col("fp").alias("b"), F.col("own").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    edges = ends.union(classes.join(owner, "fp").select(F.col("cls").alias("a"), F.col("own").alias("b"))).where("a <> b")

    sets_of = rows.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    # Keys of different bands come from different hash functions: they are equal by chance only.
    keyed = cut(sets_of.select("cls", "n", F.explode("bands").alias("at")), "bands")
    size = cut(keyed.groupBy("at").agg(F.count("*").alias("m"), F.min("cls").alias("first")).where("m > 1"), "band-sizes")
    held = cut(_of_keys(keyed, size, size.select("at", F.col("m").alias("n"))), "held")
    alike = F.least("n", "n2") >= least * F.greatest("n", "n2") - 1e-9
    few, many = held.where(F.col("m") <= paired), held.where(F.col("m") > paired)
    # At most ``paired`` classes come together here.
    near = few.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("all"))
    small = near.select("all", F.posexplode("all").alias("i", "y")).select("y", F.explode(F.slice("all", 1, F.col("i"))).alias("x"))
    small = small.select(F.col("y.cls").alias("a"), F.col("x.cls").alias("b"), F.col("y.n").alias("n"), F.col("x.n").alias("n2")).where(alike).select("a", "b")
    star = many.select(F.col("cls").alias("a"), F.col("first").alias("b")).where(F.col("a") > F.col("b"))
    pairs = cut(small.union(star).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(many.select("cls")).distinct()
    sample = members.join(wanted, "cls").groupBy("cls").agg(F.min(F.struct("id", "hash")).alias("one")).select("cls", "one.id", "one.hash")
    sets = cut(_sets(docs, sample, id_col, text_col, width), "shingle-sets")
    edges = cut(edges.union(_verified(pairs, sets, least)), "links")

    if not many.isEmpty():
        now = many.select("at", "cls", "n").join(components(edges).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        now = cut(now, "crowded")
        open_ = now.groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("at", "n")
        open_ = cut(open_, "open-keys")
        left = cut(_of_keys(now.select("at", "cls", "root"), open_.select("at"), open_).select("cls", "root").distinct(), "open-classes")
        edges = edges.union(_verified(_across(left.join(sets, "cls"), least, paired), sets, least))

    named = classes.join(components(edges).withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least", "n")
    named = cut(named, "roots")
    names = cut(named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")), "names")
    own = named.groupBy("cls", "root").agg(F.sum("n").alias("n"))
    by_class = cut(join_unique(own, names.select("root", "component"), "root", names.select("root", "n"), own.count()).select("cls", "component", "n"), "class-names")
    return join_unique(members, by_class.select("cls", "component"), "cls", by_class.select("cls", "n"), members.count()).select("id", "hash", "times", "component")


def _small(keys: DataFrame) -> DataFrame:
    """Keys to be broadcast if they are few; else Spark deals both sides out."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, all columns, that name their component of ``near_copies``: one of each, whichever other columns repeated
    rows differ in. Only rows that repeat id and text are dealt out as a whole."""
    groups = near_copies(docs, id_col, text_col, **how)
    same = F.col("component.id").eqNullSafe(F.col("id")) & (F.col("component.hash") == F.col("hash"))
    gone = cut(groups.where(~same).select(F.col("id").alias("__id"), F.col("hash").alias("__hash")), "gone")
    gone = _small(gone)
    many = cut(groups.where(same & (F.col("times") > 1)).select(F.col("id").alias("__id"), F.col("hash").alias("__hash")), "repeated")
    of = "__of"
    while of in docs.columns:
        of += "_"
    tagged = docs.withColumn(of, F.xxhash64(text_col))
    meets = lambda keys: tagged[id_col].eqNullSafe(keys["__id"]) & (tagged[of] == keys["__hash"])
    kept = tagged.join(gone, meets(gone), "left_anti")
    if many.isEmpty():
        return kept.select(docs.columns)
    meets = lambda keys: kept[id_col].eqNullSafe(keys["__id"]) & (kept[of] == keys["__hash"])
    many = _small(many)
    once = kept.join(many, meets(many), "left_anti")
    first = kept.join(many, meets(many), "left_semi").dropDuplicates([id_col, of])
    return once.unionByName(first).select(docs.columns)
