"""Personal data: e-mail and IP addresses, card and phone numbers.

Base spans are fixed patterns (``base_spans``). Beside them generators propose many, also overlapping, spans: every run of up
to eight digit groups that separators join, and every two names that some form of "at" and "dot" join. Boosted trees score
each proposal from its format (groups, separators, check digit, ends) and its context (what stands next to it, digits and
letters around, cue words before). Those over their kind's threshold are chosen best first, none overlapping another.
Base spans always stay; a proposal is only added where it overlaps no base span, or holds one of its own kind and is wider.

No table marks personal data, so the trees learn from a sample of texts (about ``SAMPLE``, drawn by hash): proposals equal to
a base span are positive, those inside a match that a base rule dropped are left out, all others negative. Into places of
the same texts made-up data is written in forms that base patterns miss (spelled out, split, run together), as positives,
and look-alikes (dates, counts, serial numbers, tokens), as negatives. A third of the texts is held back: on it scores are
calibrated and each kind's threshold is the least that keeps ``PRECISION``; a kind that never reaches it adds nothing.

Null and empty texts have no spans; rows that repeat an id each give a row, ids may be null; very long texts are read whole
and in time linear in their length. Ties: the longer, then the earlier proposal. Offsets are code points, ends exclusive.
An empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.llm import boosting

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Texts to learn from (about), proposals of one of them at most, precision that a threshold keeps.
SAMPLE, PER_TEXT, PRECISION = 2000, 48, 0.99
#: Digit groups of a proposal at most, characters of context.
GROUPS, AROUND = 8, 24

#: Words that stand before such data, and before numbers of other kinds.
CUES = frozenset("tel telephone phone mobile cell fax call contact whatsapp email mail address card visa mastercard amex credit debit ip host server client account téléphone teléfono telefon correo carte tarjeta karte".split())
OTHERS = frozenset("isbn issn version release order invoice item part serial ref reference page pages chapter section date year token key hash id number no code build figure table".split())

_LOCAL = r"[A-Za-z0-9._%+-]"
_BEFORE_AT = re.compile(_LOCAL)
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
#: What may stand between two digit groups of one number.
_JOINT = re.compile(r"[ \xa0]?(?:[\[({]?\.[\])}]?|[-\u2010-\u2014/]|\)|\(|\) ?-?)?[ \xa0]?\(?")
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot )"
_AT = re.compile(rf"(?i)(?:@|[\[({{<] ?at ?[\])}}>]|(?<= )at(?= )) {{0,2}}([a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}})+)")
_DOTS = re.compile(rf"(?i){_DOT}")
_OPEN_LOCAL = re.compile(r"[\w.%+-]{1,64}")
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Leftmost matches of each kind's pattern, and whether they pass its check. Each kind in order; all in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _BEFORE_AT.match(text, start - 1):
            start -= 1
        m = _AFTER_AT.match(text, at) if start < at else None
        if m:
            yield Span(EMAIL, start, m.end()), True
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _CHAIN.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            yield Span(IP, start, end), all(map(_byte, four))
            start = end + 1
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        yield Span(CARD, *m.span()), 14 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield Span(PHONE, *m.span()), 10 <= sum(c.isdigit() for c in m.group()) <= 15


def base_spans(text: str | None) -> list[Span]:
    """The base spans by start, then kind."""
    return sorted((s for s, ok in base_matches(text or "") if ok), key=lambda s: (s.start, s.kind))


def proposals(text: str) -> list[tuple[Span, list[float]]]:
    """Every proposed span with the features of its format."""
    out: list[tuple[Span, list[float]]] = []
    last = 0
    for m in _AT.finditer(text):
        head = text[max(last, m.start() - 72) : m.start()]
        bare = head.rstrip(" ")
        local = _OPEN_LOCAL.search(bare[::-1])
        if not local or local.start() or len(head) - len(bare) > 2:
            continue
        start, name, domain = m.start() - (len(head) - len(bare)) - len(local.group()), local.group()[::-1], m.group(1)
        plain, literal, spelled = sum(c.isascii() for c in name) / len(name), float("@" in m.group()), float(text[m.start() : m.start() + 2].lower() == "at")
        # The name may end before the last dot, as a sentence does.
        ends = [(d.start(), d.end()) for d in _DOTS.finditer(domain)][:GROUPS]
        for i, (_, begin) in enumerate(ends):
            stop = ends[i + 1][0] if i + 1 < len(ends) else len(domain)
            end, last_part = m.start(1) + stop, domain[begin:stop]
            out.append((Span(EMAIL, start, end), [end - start, sum(map(str.isdigit, name)), i + 2, len(name), ends[0][0], len(last_part), float(last_part.isalpha()), literal, spelled, plain, float(" dot " in domain[:stop].lower()), float(i + 1 < len(ends)), float(last_part.islower()), 0, 0, 0]))
        last = m.end()
    groups = [m.span() for m in _DIGITS.finditer(text)]
    joint = [_JOINT.fullmatch(text, a[1], b[0]) is not None if b[0] - a[1] <= 4 else False for a, b in zip(groups, groups[1:])]
    for i, (begin, _) in enumerate(groups):
        digits, sizes, between = "", [], []
        for j in range(i, min(i + GROUPS, len(groups))):
            if j > i:
                if not joint[j - 1]:
                    break
                between.append(text[groups[j - 1][1] : groups[j][0]])
            size = groups[j][1] - groups[j][0]
            if len(digits) + size > 19:
                break
            digits += text[groups[j][0] : groups[j][1]]
            sizes.append(size)
            if len(digits) < 4:
                continue
            start, end, opened = begin, groups[j][1], 0.0
            signs = "".join(between)
            if text[start - 1 : start] == "(" and ")" in signs:
                start, opened = start - 1, 1.0
            plus = text[start - 1 : start] == "+"
            start -= plus
            same = float(len(set(between)) <= 1)
            form = [end - start, len(digits), len(sizes), sizes[0], min(sizes), max(sizes), sizes[-1], float(plus), opened, signs.count("."), signs.count("-"), signs.count(" "), signs.count("/"), same, float(i > 0 and joint[i - 1]), float(j < len(joint) and joint[j])]
            if len(sizes) == 4 and max(sizes) <= 3 and all(b.strip(" []{}()") == "." for b in between) and all(_byte(text[a:b]) for a, b in groups[i : j + 1]):
                out.append((Span(IP, start + plus, end), form))
            if 14 <= len(digits) and not plus and not opened and luhn(digits):
                out.append((Span(CARD, start, end), form))
            if 7 <= len(digits) <= 15:
                out.append((Span(PHONE, start, end), form))
    return out


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0


def _context(text: str, span: Span) -> list[float]:
    before, after = text[max(0, span.start - AROUND) : span.start], text[span.end : span.end + AROUND]
    words = [w.lower() for w in _WORD.findall(before)[-3:]]
    share = lambda s, test: sum(map(test, s)) / max(1, len(s))
    return [float(span.kind == k) for k in range(4)] + [_side(before[-1:]), _side(after[:1]), share(before, str.isdigit), share(after, str.isdigit), share(before, str.isalpha), share(after, str.isalpha), share(text[span.start : span.end], str.isupper), float(any(w in CUES for w in words)), float(any(w in OTHERS for w in words)), float(before[-2:].strip()[-1:] in ("=", '"', "#", "$", "€", "£")), float(after[:1] in ("%", "$", "€", '"'))]


WIDTH = 16 + 15


def features(text: str, found: list[tuple[Span, list[float]]]) -> np.ndarray:
    return np.array([form + _context(text, s) for s, form in found], np.float32).reshape(len(found), WIDTH)


@dataclass
class Model:
    """Trees, the calibration of their log odds and each kind's threshold (over 1: never)."""

    trees: boosting.Trees | None
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple[float, ...] = (2.0,) * 4

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.zeros(len(x))
        return boosting.sigmoid(self.slope * self.trees.margin(x) + self.offset)


def find(text: str | None, model: Model) -> list[tuple[Span, bool, float]]:
    """(span, whether it is a base one, score) by start, kind, end; base spans have score 1."""
    text = text or ""
    base = base_spans(text)
    out = [(s, True, 1.0) for s in base]
    found = proposals(text) if model.trees is not None else []
    have = set(base)
    found = [f for f in found if f[0] not in have]
    if found:
        score = model.score(features(text, found))
        best = sorted((-p, s.start - s.end, s) for (s, _), p in zip(found, score.tolist()) if p >= model.thresholds[s.kind])
        # Starts and ends of base spans, which may overlap each other across kinds: the furthest end so far tells.
        starts = [s.start for s in base]
        taken: list[tuple[int, int]] = []
        for p, _, s in best:
            own = [b for b in base[_first_over(base, s.start) : bisect.bisect_left(starts, s.end)] if b.end > s.start]
            if any(b.kind != s.kind or b.start < s.start or b.end > s.end for b in own):
                continue
            at = bisect.bisect_left(taken, (s.start, s.end))
            if at and taken[at - 1][1] > s.start or at < len(taken) and taken[at][0] < s.end:
                continue
            taken.insert(at, (s.start, s.end))
            out.append((s, False, -p))
    return sorted(out, key=lambda r: (r[0].start, r[0].kind, r[0].end))


def _first_over(base: list[Span], start: int) -> int:
    """Number of a base span from which on others may reach over ``start``: spans of one kind do not overlap, so at most four
    that begin before it can."""
    at = bisect.bisect_left(base, start, key=lambda s: s.start)
    seen: set[int] = set()
    while at > 0 and len(seen) < 4:
        at -= 1
        seen.add(base[at].kind)
        if len(seen) == 4:
            break
    return at


# What is written into sample texts.


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    body = str(rng.integers(3, 7)) + _digits(rng, 14)
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _name(rng: np.random.Generator, text: str) -> str:
    at = int(rng.integers(len(text) + 1))
    words = [w for w in _WORD.findall(text[max(0, at - 40) : at + 40]) if 2 <= len(w) <= 12] or ["name"]
    return words[int(rng.integers(len(words)))]


def _pick(rng: np.random.Generator, options):
    return options[int(rng.integers(len(options)))]


def _made(rng: np.random.Generator, text: str) -> tuple[str, list[Span]]:
    """Made-up data in a form that base patterns miss or find, and its spans."""
    kind = int(rng.integers(5))
    if kind == EMAIL:
        local = _name(rng, text) + _pick(rng, ["", ".", "_", "-"]) + _pick(rng, ["", _digits(rng, 2), _name(rng, text)])
        at, dot = _pick(rng, [("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", "."), ("(at)", ".")])
        domain = dot.join([re.sub("[^a-z0-9]", "x", _name(rng, text).lower()), *_pick(rng, [["com"], ["org"], ["example", "net"], ["co", "uk"], ["de"], ["fr"], ["edu"]])])
        value = local.rstrip("._-") + at + domain
        return value, [Span(EMAIL, 0, len(value))]
    if kind == IP:
        value = _pick(rng, [".", "[.]", " . ", "(.)"]).join(str(v) for v in rng.integers(0, 256, 4))
        return value, [Span(IP, 0, len(value))]
    if kind == CARD:
        number, gap = _card(rng), _pick(rng, [" ", "-", "", ".", " ", " - "])
        value = gap.join(number[i : i + 4] for i in range(0, 16, 4))
        return value, [Span(CARD, 0, len(value))]
    a, b, c, land = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), _pick(rng, ["+1 ", "+1-", "+1", "1-", "00 1 ", "", "", "", "+44 ", "+49 "])
    value = land + _pick(rng, [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"{a[:2]} {b[:2]} {c[:2]} {c[2:]} {a[1:]}"])
    if kind == PHONE or not value.startswith("+"):
        return value, [Span(PHONE, 0, len(value))]
    # run together with what follows, which the base pattern drops
    more = _pick(rng, [_card(rng), ".".join(str(v) for v in rng.integers(10, 256, 4))])
    return f"{value} {more}", [Span(PHONE, 0, len(value)), Span(IP if "." in more else CARD, len(value) + 1, len(value) + 1 + len(more))]


def _alike(rng: np.random.Generator, text: str) -> str:
    """What looks like personal data and is none."""
    y, m, d = int(rng.integers(1900, 2040)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
    return _pick(
        rng,
        [f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{y}-{m:02}-{d:02} {d:02}:{m:02}:00", f"{d},{_digits(rng, 3)},{_digits(rng, 3)}", f"{d} {_digits(rng, 3)} {_digits(rng, 3)}", _digits(rng, int(rng.integers(7, 17))), f"978-{d}-{_digits(rng, 2)}-{_digits(rng, 6)}-{m % 10}",
         f"{y}-{y + 1}", f"pp. {_digits(rng, 3)}-{_digits(rng, 3)}", " ".join(_digits(rng, 2) for _ in range(6)), f"v{m}.{d}.{_digits(rng, 4)}", f"{m}.{d}.{m}", f"{_digits(rng, 3)}.{_digits(rng, 4)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}", f"{_name(rng, text)} at {_name(rng, text)}. {_name(rng, text)}",
         "".join(_pick(rng, "0123456789abcdef") for _ in range(int(rng.integers(16, 41)))), f"token = \"{''.join(_pick(rng, '0123456789abcdef') for _ in range(40))}\"", f"{_digits(rng, 5)} {_digits(rng, 5)}", f"#{_digits(rng, 8)}", f"${d},{_digits(rng, 3)}.{_digits(rng, 2)}", f"{m}.{d}.{y}.{_digits(rng, 5)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}", f"{_digits(rng, 6)}/{_digits(rng, 4)}"],
    )


def examples(text: str, written: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) that one text gives to learn from, the same each time; ``written``: times that something made up is
    written into it."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    matches = list(base_matches(text))
    good, dropped = {s for s, ok in matches if ok}, [s for s, ok in matches if not ok and s.end - s.start >= 14]
    dropped.sort(key=lambda s: s.start)
    reach = np.maximum.accumulate([s.end for s in dropped]) if dropped else np.zeros(0)
    starts = [s.start for s in dropped]

    def open_(s: Span) -> bool:
        at = bisect.bisect_left(starts, s.end)
        return bool(at) and reach[at - 1] > s.start

    found = [f for f in proposals(text) if f[0] in good or not open_(f[0])]
    if len(found) > PER_TEXT:
        found = [found[i] for i in sorted(rng.choice(len(found), PER_TEXT, replace=False).tolist())]
    xs, ys = [features(text, found)], [np.array([s in good for s, _ in found], np.float64)]
    for k in range(written):
        at = text.find(" ", int(rng.integers(len(text) + 1)))
        at = at if at >= 0 else len(text)
        left, right = text[max(0, at - 80) : at], text[at : at + 80]
        left, right = _DIGITS.sub("", left), _DIGITS.sub("", right)
        value, spans = _made(rng, text) if k % 2 else (_alike(rng, text), [])
        cue = _pick(rng, ["", "", "", "", _pick(rng, sorted(CUES if k % 2 else OTHERS)) + _pick(rng, [": ", " "])])
        left = f"{left} {cue}"
        whole = left + value + _pick(rng, [" ", " ", ", ", ". ", "\n"]) + right
        mine = {Span(s.kind, s.start + len(left), s.end + len(left)) for s in spans}
        found = [f for f in proposals(whole) if f[0].end > len(left) and f[0].start < len(left) + len(value)]
        xs.append(features(whole, found))
        ys.append(np.array([s in mine for s, _ in found], np.float64))
    return np.concatenate(xs), np.concatenate(ys)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = PRECISION) -> Model:
    """held: rows that calibrate and set thresholds, the others teach the trees."""
    if not (y[~held].any() and y[held].any()):
        return Model(None)
    trees = boosting.fit(x[~held], y[~held])
    z = trees.margin(x[held])
    slope, offset = boosting.calibrate(z, y[held])
    p, kind, limits = boosting.sigmoid(slope * z + offset), x[held][:, 16:20].argmax(1), []
    for k in range(4):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-p[own], kind="stable")]
        right = np.cumsum(y[held][own])
        # One more mistake than seen, so that few rows are never enough.
        kept = np.flatnonzero((right >= precision * (np.arange(len(own)) + 2)) & (np.append(p[own][1:], -1.0) < p[own]))
        # Between the last one kept and the next one.
        below = np.append(p[own], 0.0)
        limits.append(float(max(0.5, (below[kept[-1]] + below[kept[-1] + 1]) / 2)) if len(kept) else 2.0)
    return Model(trees, slope, offset, tuple(limits))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model from about ``sample`` texts, of which a third sets the thresholds; where there are fewer, more is written into
    each (up to ten times as much). The driver gets features only: the rows of all are bounded by about a hundred times
    ``sample``, of 31 numbers each."""
    n = docs.count()
    written = 6 * max(1, min(10, sample // max(1, n)))
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit("personal")), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.where(F.col(text_col).isNotNull() & (draw < min(1.0, sample / max(1, n)))).select(F.col(text_col).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(zlib.crc32(t.encode("utf-8", "surrogatepass")), *examples(t, written)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary()), pa.array([r[2].astype("u1").tobytes() for r in rows], pa.binary())], ["text", "x", "y"])

    got = picked.mapInArrow(run, "text bigint, x binary, y binary").toArrow()
    rows = sorted(zip(got["text"].to_pylist(), got["x"].to_pylist(), got["y"].to_pylist()))
    if not rows:
        return Model(None)
    y = [np.frombuffer(r[2], "u1") for r in rows]
    held = np.repeat([r[0] % 3 == 0 for r in rows], [len(a) for a in y])
    return fit(np.concatenate([np.frombuffer(r[1], "<f4").reshape(-1, WIDTH) for r in rows]), np.concatenate(y).astype(float), held)


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """``id_col`` and spans of every row; with ``redact`` also redacted, the text with [KIND] in place of each span (spans that
    overlap are one, under the first one's name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            spans, texts = [], []
            for value in batch.column(1):
                text = value.as_py()
                own = find(text, model)
                spans.append([{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "base": b, "score": p} for s, b, p in own])
                if redact:
                    texts.append(text if text is None else hide(text, [s for s, *_ in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), *([pa.array(texts, pa.string())] if redact else [])], [id_col, "spans", *(["redacted"] if redact else [])])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, spans {SPANS}" + (", redacted string" if redact else ""))


def hide(text: str, spans: list[Span]) -> str:
    out, last = [], 0
    for s in spans:
        if s.start >= last:
            out += [text[last : s.start], f"[{KINDS[s.kind].upper()}]"]
        last = max(last, s.end)
    return "".join(out) + text[last:]


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``id_col``, n_email, n_ip, n_card and n_phone (base spans), base_sha256, spans (all, as text) and n_added of every row."""
    found = detect(docs, model or learn(docs, id_col, text_col), id_col, text_col)
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"))
