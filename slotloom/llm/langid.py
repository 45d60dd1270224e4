"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A word is a run of letters of the lower-cased text; its subwords are its character n-grams between ``<`` and ``>``,
hashed to buckets. A text is the mean of its subwords' embeddings. After training, embedding times softmax weights is
one table of scores a bucket, so a text's logits are the mean of its words' rows.

Training takes about ``per_lang`` rows of each language (fewer each beyond 64 languages, ``ROWS`` in all but five a
language at least: documented bounds), chosen by a hash of id and text; rows that repeat text and language count once.
Counts of subwords are made on the executors, so the driver gets at most BUCKETS numbers a row.

Rejection is calibrated on text outside the classes. Each learned row also gives a text of no language, made from its
own: its letters are exchanged by a random alphabet, dealt anew, turned to another script, replaced by one word said
over and over, or set as program code. These train one more class, which is never predicted; a temperature is fitted on
a fifth of all rows, and ``reject_below`` is the score up to a half that parts that fifth's right texts from its foreign
ones best (a right text lost costs ten times a foreign one kept). ``outside_rejected`` is the share of its foreign texts
that fall under it. Texts of under SHORT letters make no foreign text: so little cannot be told from a language. A score
is the probability of the language among all classes.

Null texts and texts without letters: ``und`` with score 0, rejected. Without training rows every text is ``und``.
Equal scores go to the first language by name. Very long texts are read whole, a chunk of their own. Repeated rows each
get their row; an empty table gives no rows; extra columns, also such as are named like the results, do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.wordstream import CHUNK, LETTER, Memo, Stream, chunks, ragged

BUCKETS, DIM, NGRAMS = 1 << 12, 16, (1, 2, 3, 4)
PER_LANG, ROWS = 400, 64 * 400
UNKNOWN = "und"


def subwords(stream: Stream, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' n-grams, index of the word of each)."""
    size = end - begin + 2
    at = np.cumsum(size) - size
    codes = np.zeros(int(size.sum()), np.uint64)
    inside = np.ones(len(codes), bool)
    inside[at] = inside[at + size - 1] = False
    codes[at], codes[at + size - 1] = ord("<"), ord(">")
    codes[inside] = stream.codes[ragged(begin, end - begin)]
    word = np.repeat(np.arange(len(size)), size)
    left = size[word] - (np.arange(len(codes)) - at[word])
    out, owner, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = h * np.uint64(0x100000001B3) + shifted + np.uint64(n)
        if n in NGRAMS:
            whole = left >= n
            mixed = h[whole] * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owner.append(word[whole])
    return np.concatenate(out), np.concatenate(owner)


def _stream(texts: list[str | None]) -> Stream:
    return Stream([t.lower() if t else "" for t in texts])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x (language, and last the class of no language)
    bias: np.ndarray
    temperature: float
    reject_below: float
    outside_rejected: float = float("nan")


class Scorer:
    """Logits of texts; words seen before are not hashed again."""

    def __init__(self, model: Model):
        self.model, self.memo = model, Memo(1 << 18)
        self.clear()

    def clear(self) -> None:
        self.memo.clear()
        self.rows = np.zeros((0, self.model.table.shape[1] + 1))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of the languages, whether a text has a letter)."""
        n, k = len(texts), self.model.table.shape[1]
        stream = _stream(texts)
        begin, end = stream.runs(stream.cls == LETTER)
        if not len(begin):
            return np.zeros((n, k))[:, : len(self.model.langs)], np.zeros(n, bool)
        key, first, inverse = np.unique(stream.keys(begin, end), return_index=True, return_inverse=True)
        if self.memo.size > self.memo.most:
            self.clear()
        row, new = self.memo.find(key)
        if new.any():
            bucket, owner = subwords(stream, begin[first[new]], end[first[new]])
            order = np.argsort(owner, kind="stable")
            bucket, owner = bucket[order], owner[order]
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sums = np.add.reduceat(self.model.table[bucket], cuts, axis=0)
            rows = self.memo.add(key[new])
            self.rows = np.concatenate([self.rows, np.column_stack([sums, np.diff(np.append(cuts, len(owner)))])])
            row[new] = rows
        at = stream.per_text(begin)
        some = at[1:] > at[:-1]
        totals = np.zeros((n, k + 1))
        totals[some] = np.add.reduceat(self.rows[row][inverse], at[:-1][some], axis=0)
        z = (totals[:, :k] / np.maximum(totals[:, k:], 1) + self.model.bias) * self.model.temperature
        return _softmax(z)[:, : len(self.model.langs)], some


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def foreign(text: str, kind: int, rng: np.random.Generator) -> str:
    """A text of no language, as long as ``text`` about, made from its letters in one of FOREIGN ways."""
    low = text.lower()
    letters = [c for c in low if c.isalpha()]
    if len(letters) < SHORT:
        return ""
    letters = sorted(set(letters))
    words = low.split()
    if kind == 0:  # another alphabet of the same script
        return low.translate(dict(zip(map(ord, letters), rng.permutation(letters).tolist())))
    if kind == 1:  # letters dealt anew
        flat = rng.permutation([c for c in low if not c.isspace()]).tolist()
        cuts = np.cumsum([0, *map(len, words)])
        return " ".join("".join(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))
    if kind == 2:  # another script
        start = int(rng.choice(SCRIPTS))
        return low.translate({ord(c): start + i % 24 for i, c in enumerate(rng.permutation(letters).tolist())})
    if kind == 3:  # a few short words, said over and over
        few = ["".join(rng.choice(list(LATIN), 1 if rng.random() < 0.5 else 2)) * int(rng.integers(2, 5)) for _ in range(int(rng.integers(1, 4)))]
        return " ".join(few[i % len(few)] for i in range(max(1, min(len(words), 200))))
    if kind == 4:  # program text
        names = ["".join(rng.choice(list(LATIN), rng.integers(1, 7))) for _ in range(12)]
        line = lambda: " ".join(rng.choice([*CODE, *names], rng.integers(3, 9)))
        return "\n".join(line() for _ in range(max(1, min(len(words) // 6, 60))))
    return "".join(rng.choice(list(LATIN + "     "), max(1, min(len(low), 2000))))  # letters at random


FOREIGN, SHORT = 6, 25
LATIN = "abcdefghijklmnopqrstuvwxyz"
# First letters of some scripts, and words of program text.
SCRIPTS = [0x3B1, 0x430, 0x561, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0, 0x3042, 0x4E00, 0xAC00]
CODE = "def return if else for in while import from class self none true false int char void static public const var let function new this null print lambda try except".split()


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, share) in enumerate(rows):
        x[i, at] = share
    return x


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], epochs: int = 40, seed: int = 3) -> Model:
    """rows: (buckets, shares that sum to 1) of each text; y: language numbers, len(langs) for no language."""
    rng = np.random.default_rng(seed)
    n, k = len(rows), len(langs) + 1
    order = rng.permutation(n)
    checked, taught = order[: n // 5], order[n // 5 :]
    emb = rng.normal(0, 0.5, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    target = np.eye(k, dtype=np.float32)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        for lo in range(0, len(taught), 16):
            at = taught[lo : lo + 16]
            xb = _dense([rows[i] for i in at])
            h = xb @ emb
            g = (_softmax(h @ w + bias) - target[y[at]]) / len(at)
            gh = g @ w.T
            w -= 1.0 * rate * (h.T @ g)
            bias -= 0.2 * rate * g.sum(0)
            emb -= 60.0 * rate * (xb.T @ gh)
        taught = rng.permutation(taught)
    table = emb @ w
    held = checked if len(checked) >= k * 5 else order
    z = np.stack([table[rows[i][0]].T @ rows[i][1] for i in held]) + bias
    grid = np.geomspace(0.25, 8, 26)
    # Smoothed targets: rows that all fall on the right side must not make scores ever surer.
    soft = np.full((len(held), k), 1 / (len(held) + 2) / k)
    soft[np.arange(len(held)), y[held]] += 1 - 1 / (len(held) + 2)
    loss = [-(soft * np.log(np.maximum(_softmax(t * z), 1e-12))).sum(1).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(t * z)[:, : k - 1]
    top, inside = p.max(1), y[held] < k - 1
    right = top[inside & (p.argmax(1) == y[held])]
    outside = top[~inside]
    reject = _threshold(right, outside)
    return Model(langs, table.astype(np.float64), bias.astype(np.float64), t, reject, float(np.mean(outside < reject)) if len(outside) else float("nan"))


def _threshold(right: np.ndarray, outside: np.ndarray) -> float:
    """The score, up to a half, that parts right texts from foreign ones with the least loss: a right text rejected costs
    ten times a foreign one accepted. The middle of equals."""
    if not len(right):
        return 0.5
    grid = np.arange(1, 51) / 100
    loss = [10 * np.mean(right < t) + (np.mean(outside >= t) if len(outside) else 0.0) for t in grid]
    best = grid[np.isclose(loss, min(loss))]
    return float(best[len(best) // 2])


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Model from rows with a language; rows: only those that may be learned from."""
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = known.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.5)
    per_lang = max(5, min(per_lang, ROWS // len(counts)))
    share = F.element_at(F.map_from_arrays(F.array(*[F.lit(r[0]) for r in counts]), F.array(*[F.lit(per_lang / r[1]) for r in counts])), F.col("lang"))
    draw = F.pmod(F.xxhash64("id", "text", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < share).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, CHUNK // 2):  # each text is met by a foreign one
                own = texts[lo:hi]
                made = []
                for t in own:
                    seed = zlib.crc32(t.encode("utf-8", "surrogatepass"))
                    made.append(foreign(t, seed % FOREIGN, np.random.default_rng(seed)))
                keys, shares = [], []
                stream = _stream(own + made)
                begin, end = stream.runs(stream.cls == LETTER)
                bucket, owner = subwords(stream, begin, end) if len(begin) else (np.zeros(0, np.int64),) * 2
                owner = stream.text_of(begin)[owner] if len(begin) else owner
                pair, count_ = np.unique(owner * BUCKETS + bucket, return_counts=True)
                cuts = np.searchsorted(pair, np.arange(2 * len(own) + 1) * BUCKETS)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    keys.append((pair[a:b] % BUCKETS).astype(np.int32))
                    shares.append((count_[a:b] / max(1, count_[a:b].sum())).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi] + [None] * len(made), pa.string()), pa.array(keys, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "at", "share"])

    table = picked.mapInArrow(count, "lang string, at array<int>, share array<float>").toArrow()
    part = lambda name, kind: [np.asarray(x.values, kind) for x in table[name]]
    got = sorted(zip(table["lang"].to_pylist(), part("at", np.int64), part("share", np.float32)), key=lambda r: (r[0] is None, r[0] or "", len(r[1]), r[1].tobytes()))
    got = [r for r in got if len(r[1])]
    langs = sorted({r[0] for r in got if r[0] is not None})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.5)
    number = {x: i for i, x in enumerate(langs)} | {None: len(langs)}
    return fit([r[1:] for r in got], np.array([number[r[0]] for r in got]), langs)


def _answers(docs: DataFrame, model: Model):
    """A function that makes a worker's scorer: texts to (languages, scores, accepted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        score = Scorer(model)

        def run(texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
            langs, scores = [], []
            for lo, hi in chunks(texts):
                p, letters = score(texts[lo:hi]) if model.langs else (np.zeros((hi - lo, 1)), np.zeros(hi - lo, bool))
                langs += [model.langs[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1).tolist(), letters.tolist())]
                scores += np.where(letters, p.max(1), 0.0).tolist()
            return langs, scores, [x != UNKNOWN and s >= model.reject_below for x, s in zip(langs, scores)]

        return run

    return start


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score and accepted of every row."""
    start = _answers(docs, model)
    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = start()
        for batch in batches:
            langs, scores, accepted = answer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[id_col, "lang_pred", "score", "accepted"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose language is not rejected."""
    start, at = _answers(docs, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = start()
        for batch in batches:
            yield batch.filter(pa.array(answer(batch.column(at).to_pylist())[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows of the fold that is never learned from; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from the rows outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))
    return train(docs.where(fold != 2), lang_col, text_col, id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts all: id, held_out, lang_pred, score, accepted."""
    model = learn(docs, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "accepted")
