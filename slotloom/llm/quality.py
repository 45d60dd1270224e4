"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), then a logistic calibration:
the sum-of-squares identity makes the pairwise part linear in the number of features. Features of a text: the shares of
its hashed lower-cased words, statistics of its letters, words and lines, and metadata: the recorded length, given by a
numeric column (null, negative or absent: the text's own), and how far it is from the text's own. Numbers also enter as
quantile classes, one feature each.

Training takes about ``sample`` labelled rows (a documented bound) chosen by a hash of id and text; rows that repeat text
and label count once, so no hot id can bring more. Features are made on the executors. The calibration is fitted on
out-of-fold scores of all these rows, with a prior that holds its slope near 1 and steps that are halved until the loss
falls. Null texts count as empty; empty texts get the score of empty features. Rows with a null label are not learned
from; with labels of one class or none every score is their share (0.5 without labels). Very long texts are read whole.
Repeated rows each get their row, equal texts of equal metadata the same score; an empty table gives no rows; extra
columns, also such as are named like the results, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.wordstream import LETTER, NUMBER, SPACE, Stream, chunks

WORDS, FACTORS, CLASSES = 1 << 12, 8, 8
SAMPLE = 6000
THRESHOLD = 0.7
STATS = ["chars", "words", "lines", "word_len", "line_len", "upper", "letter", "digit", "space", "sign", "ascii_sign", "bang", "pipe", "comma", "dot", "distinct_words", "distinct_lines", "long_words", "short_words", "top_line", "first_upper", "sign_words", "sign_ends"]
META = ["recorded", "recorded_off"]
FOLDS = 4


def features(texts: list[str | None], recorded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word bucket, share of the text's words; statistics and metadata, one row a text). recorded: lengths as
    recorded, NaN where there is none."""
    raw = Stream(texts)
    n, codes, cls = len(texts), raw.codes, raw.cls
    sizes = np.diff(raw.text_at).astype(np.float64)
    some = np.maximum(sizes, 1)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[raw.text_at[1:]] - sums[raw.text_at[:-1]]).astype(np.float64)

    begin, end = raw.runs(cls != SPACE)
    word_at = raw.per_text(begin)
    words = np.diff(word_at).astype(np.float64)
    w = np.maximum(words, 1)
    lower = codes.copy()
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
    lower[upper] += 32
    low = Stream.__new__(Stream)
    low.__dict__.update(raw.__dict__)
    changed = raw.bytes.copy()
    ascii_upper = (changed >= 65) & (changed <= 90)
    changed[ascii_upper] += 32
    low.bytes = changed
    key = low.keys(begin, end)
    owner = np.repeat(np.arange(n), np.diff(word_at))
    bucket = (key >> np.uint64(20)).astype(np.int64) % WORDS
    pair, count = np.unique(owner * WORDS + bucket, return_counts=True)
    text, bucket = pair // WORDS, pair % WORDS
    distinct = np.bincount(text, minlength=n)
    lb, le = raw.runs(codes != 10)
    line_at = raw.per_text(lb)
    lines = np.diff(line_at).astype(np.float64)
    line_owner = np.repeat(np.arange(n), np.diff(line_at))
    line_key = raw.keys(lb, le) ^ (line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen = np.unique(line_key, return_index=True)[1]
    distinct_lines = np.bincount(line_owner[seen], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, line_owner, le - lb)
    size = (end - begin).astype(np.float64)
    by = lambda v: np.bincount(owner, weights=v, minlength=n)
    sign = (cls != SPACE) & (cls > NUMBER)
    has_sign = np.concatenate([[0], np.cumsum(sign)])
    if recorded is None:
        recorded = np.full(n, np.nan)
    noted = np.where(recorded >= 0, np.nan_to_num(recorded), sizes)
    stats = np.column_stack([
        np.log1p(sizes), np.log1p(words), np.log1p(lines), by(size) / w, np.log1p(sizes / np.maximum(lines, 1)), total(upper) / some,
        total(cls == LETTER) / some, total(cls == NUMBER) / some, total(cls == SPACE) / some, total(sign) / some, total(sign & (codes < 128)) / some,
        total(codes == 33) / some, total(codes == 124) / some, total(codes == 44) / some, total(codes == 46) / some, distinct / w, distinct_lines / np.maximum(lines, 1),
        by(size > 12) / w, by(size < 3) / w, longest / some, by(upper[begin]) / w if len(begin) else np.zeros(n),
        by(has_sign[end] - has_sign[begin] > 1) / w if len(begin) else np.zeros(n), by(sign[end - 1]) / w if len(begin) else np.zeros(n),
        np.log1p(noted), np.log1p(noted) - np.log1p(sizes),
    ])
    return text, bucket, count / w[text], stats


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray  # statistic x (CLASSES - 1)
    slope: float
    shift: float

    def dense(self, stats: np.ndarray) -> np.ndarray:
        """Statistics as numbers of a common scale and as one-hot quantile classes."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        k = np.stack([(stats[:, [j]] > self.cuts[j]).sum(1) for j in range(stats.shape[1])], 1)
        one = np.zeros((len(stats), stats.shape[1], CLASSES))
        np.put_along_axis(one, k[:, :, None], 0.5, 2)
        return np.concatenate([z, one.reshape(len(stats), -1)], 1)

    def score(self, texts: list[str | None], recorded: np.ndarray | None = None) -> np.ndarray:
        text, bucket, share, stats = features(texts, recorded)
        n, x = len(texts), np.sqrt(share)
        d = self.dense(stats)
        w, v = self.weight, self.factor
        linear = self.bias + d @ w[WORDS:] + np.bincount(text, weights=w[bucket] * x, minlength=n)
        sums, squares = d @ v[WORDS:], d**2 @ v[WORDS:] ** 2
        for f in range(v.shape[1]):
            sums[:, f] += np.bincount(text, weights=v[bucket, f] * x, minlength=n)
            squares[:, f] += np.bincount(text, weights=(v[bucket, f] * x) ** 2, minlength=n)
        z = linear + 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _block(rows: list[tuple], dense: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The features of some rows as one matrix."""
    x = np.zeros((len(at), WORDS + dense.shape[1]), np.float32)
    for i, j in enumerate(at.tolist()):
        x[i, rows[j][0]] = np.sqrt(rows[j][1])
    x[:, WORDS:] = dense[at]
    return x


def _forward(x: np.ndarray, w: np.ndarray, v: np.ndarray, b: np.float32) -> tuple[np.ndarray, np.ndarray]:
    s = x @ v
    return b + x @ w + 0.5 * (s**2 - (x**2) @ v**2).sum(1), s


def _learn(rows: list[tuple], dense: np.ndarray, y: np.ndarray, taught: np.ndarray, epochs: int, updates: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.float32]:
    """(weights, factors, bias) by adaptive gradient steps on batches of 64 of the rows ``taught``."""
    rng = np.random.default_rng(seed)
    size, n = WORDS + dense.shape[1], len(taught)
    share = np.clip(y[taught].mean(), 0.5 / n, 1 - 0.5 / n)
    w, v, b = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32), np.float32(np.log(share / (1 - share)))
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), np.float32(1e-6)
    for _ in range(max(epochs, -(-updates * 64 // n))):
        taught = rng.permutation(taught)
        for lo in range(0, n, 64):
            at = taught[lo : lo + 64]
            xb = _block(rows, dense, at)
            z, s = _forward(xb, w, v, b)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)).astype(np.float32)
            dw = xb.T @ g + 1e-5 * w
            dv = xb.T @ (g[:, None] * s) - ((xb**2).T @ g)[:, None] * v + 1e-4 * v
            db = g.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= 0.1 * dw / np.sqrt(gw)
            v -= 0.03 * dv / np.sqrt(gv)
            b -= 0.05 * db / np.sqrt(gb)
    return w, v, b


def calibrate(z: np.ndarray, y: np.ndarray, prior: float = 4.0) -> tuple[float, float]:
    """(slope, shift) of a logistic curve through scores z: Newton steps, each halved until the loss falls, with smoothed
    targets and a prior on the slope that counts like ``prior`` rows, so neither can run off."""
    up, down = y.sum(), (1 - y).sum()
    t = y * (up + 1) / (up + 2) + (1 - y) / (down + 2)
    spread = max(float(np.abs(z).mean()), 1e-9)

    def loss(a: float, b: float) -> float:
        m = a * z + b
        return float((np.logaddexp(0, m) - t * m).sum() + 0.5 * prior * spread**2 * (a - 1) ** 2 + 0.5e-3 * b * b)

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        q, r = p * (1 - p), p - t
        g = np.array([(r * z).sum() + prior * spread**2 * (a - 1), r.sum() + 1e-3 * b])
        h = np.array([[(q * z * z).sum() + prior * spread**2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        if size <= 1e-6:
            break
        a, b = a - size * step[0], b - size * step[1]
        last, now = now, loss(a, b)
        if last - now < 1e-9 * max(1.0, abs(now)):
            break
    return max(a, 0.05), b


def fit(rows: list[tuple], stats: np.ndarray, y: np.ndarray, epochs: int = 12, updates: int = 800, seed: int = 5) -> Model:
    """rows: (buckets, shares) of each text; y: 0 or 1, both present. Small samples get more epochs, for ``updates`` steps
    at least. The model learns from all rows; its calibration from scores of models that have not seen the row."""
    n = len(y)
    mean, scale = stats.mean(0), stats.std(0) + 1e-9
    cuts = np.quantile(stats, np.arange(1, CLASSES) / CLASSES, axis=0).T
    model = Model(0.0, np.zeros(0), np.zeros((0, 0)), mean, scale, cuts, 1.0, 0.0)
    dense = model.dense(stats).astype(np.float32)
    # Folds that hold both classes alike.
    fold = np.empty(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    for k in (0, 1):
        own = order[y[order] == k]
        fold[own] = np.arange(len(own)) % FOLDS
    z = np.zeros(n)
    for k in range(FOLDS):
        out = fold == k
        if out.any() and not out.all():
            model_k = _learn(rows, dense, y, np.flatnonzero(~out), epochs, updates, seed + k)
            at = np.flatnonzero(out)
            for lo in range(0, len(at), 64):
                z[at[lo : lo + 64]] = _forward(_block(rows, dense, at[lo : lo + 64]), *model_k)[0]
    slope, shift = calibrate(z, y)
    w, v, b = _learn(rows, dense, y, np.arange(n), epochs, updates, seed)
    return Model(float(b), w.astype(np.float64), v.astype(np.float64), mean, scale, cuts, slope, shift)


def _recorded(df: DataFrame, length_col: str | None):
    return (F.col(f"`{length_col}`") if length_col else F.lit(None)).cast("double")


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def train(rows: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None, sample: int = SAMPLE) -> Model:
    """rows: labelled rows that may be learned from, one or more a document. length_col: a column of recorded lengths."""
    known = rows.where(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("y"), _recorded(rows, length_col).alias("n"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(id_col).alias("id"))
    n = known.count()
    draw = F.pmod(F.xxhash64("id", "text", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < sample / max(n, 1)).groupBy("y", "text").agg(F.max("n").alias("n")).select("y", "n", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, noted = batch.column(2).to_pylist(), _numbers(batch.column(1))
            at, shares, stats = [], [], []
            for lo, hi in chunks(texts):
                text, bucket, share, s = features(texts[lo:hi], noted[lo:hi])
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                at += [bucket[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:])]
                shares += [share[a:b].astype(np.float32) for a, b in zip(cuts[:-1], cuts[1:])]
                stats += list(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())), pa.array(stats, pa.list_(pa.float64()))], ["y", "at", "share", "stats"])

    table = picked.mapInArrow(count, "y int, at array<int>, share array<float>, stats array<double>").toArrow()
    lists = lambda name: [np.asarray(x.values) if hasattr(x, "values") else x for x in table[name]]
    y = np.array(table["y"].to_pylist(), np.float64)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        width = len(STATS) + len(META)
        z, size = np.zeros(width), WORDS + width * (1 + CLASSES)
        return Model(float(np.log((p + 1e-6) / (1 - p + 1e-6))), np.zeros(size), np.zeros((size, FACTORS)), z, z + 1, np.zeros((width, CLASSES - 1)), 1.0, 0.0)
    rows_ = list(zip(lists("at"), lists("share")))
    stats = np.array(table["stats"].to_pylist())
    order = np.lexsort((*stats.T, y))  # whatever order the rows came in
    return fit([rows_[i] for i in order], stats[order], y[order])


def _scores(docs: DataFrame, model: Model):
    """A function from texts and recorded lengths to scores, for use in tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None], noted: np.ndarray) -> np.ndarray:
        return np.concatenate([shared.value.score(texts[lo:hi], noted[lo:hi]) for lo, hi in chunks(texts)]) if texts else np.zeros(0)

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``id_col``, quality_score and predicted (1 from THRESHOLD on) of every row."""
    score = _scores(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(batch.column(2).to_pylist(), _numbers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=[id_col, "quality_score", "predicted"])

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), _recorded(docs, length_col).alias("n"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, quality_score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows, all columns, whose score reaches THRESHOLD."""
    score = _scores(docs, model)
    at, noted = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.full(batch.num_rows, np.nan) if noted is None else _numbers(batch.column(noted))
            yield batch.filter(pa.array(score(batch.column(at).to_pylist(), lengths) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Documents outside the held-out fold (id, text, recorded length) with their label."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))
    own = docs.where(fold != 2).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _recorded(docs, length_col).alias("n_chars"))
    return own.join(labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality")).distinct(), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", length_col: str | None = None) -> Model:
    """Model from the labels of documents outside the held-out fold."""
    return train(labelled(docs, labels, id_col, label_col, text_col, length_col), length_col="n_chars")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """id, held_out, score, predicted of every document."""
    from slotloom.llm.langid import held_out

    model = learn(docs, labels, id_col, text_col, length_col=length_col)
    return predict(docs, model, id_col, text_col, length_col).select(id_col, held_out(id_col).alias("held_out"), F.col("quality_score").alias("score"), "predicted")
