"""Scalar text functions over slots, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MARK = "[__]"
# The shape of a marker, of a cue in brackets, and of words.
MARK_LOOSE = r"\[[\s\x{A0}]*__[\s\x{A0}]*\]"
CUE = r"\[(?![\s\x{A0}]*__[\s\x{A0}]*\])[^\]\[]*\]"
RULE_WORD = r"(\*|\[__\]|[\p{L}\p{N}_']+)"
LEXICAL_WORD = r"([a-z0-9]+(?:'[a-z0-9]+)*)"
# What is no speech, in the order in which it is taken out: cues, speaker changes, notes, tags.
NO_SPEECH = [r"\[(?!\s*__\s*\])[^\]\n]*\]", ">{2,}", "[♪♫]", r"</?[A-Za-z][^>\n]*>"]
UNIT = r"(\[__\]|[\p{L}\p{N}']+)"
PLACEHOLDER = r"(?i)^(na|n/a|unknown)$"
SIDE = r"[^\p{L}\p{N}_'’]"
SOFT_GAP = r"[\s,\"“”]+"
# Words that open a question, pronouns that follow them, and verbs of going before a place.
QUESTION = r"(?i)(?:whatever|what|how|why|where|who|when)\s+the"
PRONOUN = r"^\s*(?:I|you|he|she|they|we|it)\b"
GO_TO = r"(?i)\b(?:go|going|went|gone)\s+to\s*\z"
OPENS = r"^\s*[\"'(\[]*(?:I\b|[A-Z][a-z]|[A-Z]{2,}\s+[a-z])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_text(segs: Column | str) -> Column:
    """Text of an event: its segments one after the other; null segments are empty."""
    return F.array_join(F.transform(_col(segs), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")


def normalize_mask(text: Column | str) -> Column:
    """Non-breaking spaces to spaces, every spelling of the marker to one."""
    return F.regexp_replace(F.replace(_col(text), F.lit("\u00a0"), F.lit(" ")), MARK_LOOSE, MARK)


def count_mask(text: Column | str) -> Column:
    return F.regexp_count(normalize_mask(text), F.lit(r"\[__\]"))


def strip_labels(text: Column | str) -> Column:
    """Without bracketed cues; markers stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), CUE, " "), " +", " "))


def rule_words(text: Column | str) -> Column:
    """Lower-cased words, markers and wildcards, apostrophes folded."""
    return F.regexp_extract_all(F.lower(F.translate(normalize_mask(text), "’‘", "''")), F.lit(RULE_WORD), 1)


def rule_tokens(text: Column | str) -> Column:
    """struct<words, gaps>: words, markers and wildcards as written, apostrophes folded, and what stands before, between and
    after them (one gap more than words)."""
    folded = F.translate(normalize_mask(text), "’‘", "''")
    return F.struct(F.regexp_extract_all(folded, F.lit(RULE_WORD), 1).alias("words"), F.split(folded, RULE_WORD, -1).alias("gaps"))


def lexical_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(LEXICAL_WORD), 1)


def blank(text: Column | str, pattern: str) -> Column:
    """Every match replaced by as many spaces, so offsets stay."""
    parts = F.regexp_extract_all(_col(text), F.lit(f"({pattern})"), 1)
    gaps = F.split(_col(text), pattern, -1)
    return F.array_join(F.zip_with(gaps, parts, lambda g, p: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(p)), F.lit("")))), "")


def discovery_tokens(text: Column | str) -> Column:
    """array<struct<token, offset>> of the white-space tokens after cues, speaker changes, notes and tags are blanked in
    place."""
    clean = _col(text)
    for pattern in NO_SPEECH:
        clean = blank(clean, pattern)
    space = lambda c: c.rlike(r"^\s$")

    def starts(chars: Column) -> Column:
        first = lambda c, i: F.when((c != "") & ~space(c) & ((i == 0) | space(F.get(chars, i - 1))), i)
        return F.filter(F.transform(chars, first), lambda i: i.isNotNull())

    # Bound to a lambda's variable, the characters are split off once a text and looked up in constant time.
    places = F.get(F.transform(F.array(F.split(clean, "")), starts), F.lit(0))
    words = F.filter(F.split(clean, r"\s"), lambda w: F.length(w) > 0)
    return F.zip_with(words, places, lambda w, p: F.struct(w.alias("token"), p.cast("int").alias("offset")))


def normalize_variants(text: Column | str, variants: list[tuple[str, str]]) -> Column:
    """Ordered rewrites (pattern, replacement) of spellings to canonical words."""
    return reduce(lambda c, v: F.regexp_replace(c, v[0], v[1]), variants, F.lower(_col(text)))


def squeeze(word: Column | str) -> Column:
    """Lower-cased word with runs of three or more of a letter collapsed to one."""
    return F.regexp_replace(F.lower(F.trim(_col(word))), r"([a-z])\1{2,}", "$1")


def answers_match(predicted: Column | str, expected: Column | str, same=None, context: Column | str | None = None, compounds: list[tuple[str, str, str, str]] | None = None) -> Column:
    """Whether a prediction equals one of the expected words; ``same`` replaces the comparison (Column, Column). compounds:
    (word, answer, before, after): the word is as good as the answer where the context, in which ``[__]`` stands for the
    slot, has the text ``before`` right before it and ``after`` right after it, white space between (either may be
    empty): a slot may hide a whole compound of which one part is still to be read."""
    same = same or (lambda a, b: squeeze(a) == squeeze(b))

    def good(e: Column) -> Column:
        found = same(_col(predicted), e)
        for word, answer, before, after in compounds or []:
            near = (rf"{any_of([before])}\s+" if before else "") + MARK_LOOSE + (rf"\s+{any_of([after])}" if after else "")
            found = found | (same(_col(predicted), F.lit(word)) & same(e, F.lit(answer)) & F.coalesce(_col(context).rlike("(?i)" + near), F.lit(False)))
        return found

    return F.coalesce(F.exists(_col(expected), good), F.lit(False))


# ASCII and the Latin letters that are their own NFKC form, whatever stands between them.
NFKC_STABLE = r"\x{00}-\x{7F}\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"


@pandas_udf(StringType())
def _normalised(texts: pd.Series) -> pd.Series:
    """NFKC of a batch, once for each distinct text (Unicode 15.1, Python's tables)."""
    known = {t: unicodedata.normalize("NFKC", t) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) for t in texts], dtype=object)


def nfkc(text: Column | str) -> Column:
    """The text in Unicode's compatibility form. Texts of which no sign can change are left to the JVM; only others go
    through Arrow, in batches."""
    odd = _col(text).rlike(f"[^{NFKC_STABLE}]")
    return F.when(odd, _normalised(F.when(odd, _col(text)))).otherwise(_col(text))


def context_key(text: Column | str) -> Column:
    """Lower-cased context in compatibility form, with markers and white space of one form."""
    return F.lower(F.trim(F.regexp_replace(normalize_mask(nfkc(text)), r"\s+", " ")))


def context_shape(text: Column | str) -> Column:
    """The context's words as classes: marker, number or word."""
    words = F.split(context_key(text), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.contains(MARK), "_").when(w.rlike("^[0-9]+$"), "9").otherwise("w")), "")


def clean_metadata(value: Column | str) -> Column:
    value = F.trim(F.coalesce(_col(value), F.lit("")))
    return F.when(value.rlike(PLACEHOLDER), "").otherwise(value)


def creator_key(creator_id: Column | str, name: Column | str) -> Column:
    """``id:`` and a canonical id, else ``name:`` and the normalised name, else null."""
    # Fixed value: the platform's form of a channel id.
    key = F.trim(F.regexp_replace(F.lower(clean_metadata(name)), r"\s+", " "))
    return F.when(_col(creator_id).rlike("^UC[A-Za-z0-9_-]{22}$"), F.concat(F.lit("id:"), _col(creator_id))).when(key != "", F.concat(F.lit("name:"), key))


def hash_fold(key: Column | str, folds: int) -> Column:
    """Fold of a key: its first 32 hash bits modulo the folds; depends on the key alone."""
    return (F.conv(F.substring(F.sha2(_col(key), 256), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def half_fold(key: Column | str, salt: str) -> Column:
    """One of two folds from the lowest bit of the first hash byte."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(salt), _col(key)), 256), 1, 2), 16, 10).cast("int") % 2).cast("int")


def content_fingerprint(text: Column | str) -> Column:
    """32-bit FNV-1a over the characters' codes, in base 36."""
    codes = F.transform(F.filter(F.split(_col(text), ""), lambda c: c != ""), F.ascii)
    word = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c.cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(word.cast("string"), 10, 36))


def stable_id(kind: str, *keys: Column | str) -> Column:
    joined = F.concat_ws("\u0000", *[_col(k).cast("string") for k in keys])
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(joined, 256), 1, 20))


def membership_hash(values: Column) -> Column:
    """Aggregate: one hash of a set of strings, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(F.collect_set(values)), "\n"), 256)


def format_case(word: Column | str, before: Column | str, matched: Column | str | None = None) -> Column:
    """Upper case where the last word before of more than one letter is all upper case, or all of the two or more letters
    of the matched text (markers aside) are; a capital after a sentence's end."""
    before, word = _col(before), _col(word)
    letters = F.filter(F.regexp_extract_all(before, F.lit(r"([A-Za-z]+(?:['’][A-Za-z]+)*)"), 1), lambda w: F.length(w) > 1)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    loud = F.coalesce(F.try_element_at(letters, F.lit(-1)).rlike(r"^[A-Z'’]+$"), F.lit(False))
    if matched is not None:
        loud = loud | F.coalesce(F.regexp_replace(F.regexp_replace(_col(matched), MARK_LOOSE, ""), "[^A-Za-z]", "").rlike(r"^[A-Z]{2,}\z"), F.lit(False))
    return F.when(loud, F.upper(word)).when(before.rlike(r"[.!?]\s*\z"), capital).otherwise(word)


def any_of(words: list[str]) -> str:
    """A pattern of all phrases, longest first; white space in them matches any."""
    literal = lambda w: "".join(r"\s+" if c == " " else "['’]" if c == "'" else c if c.isalnum() else "\\" + c for c in w)
    return "(?:" + "|".join(literal(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def _goes_on(before: Column, after: Column, continuing: list[str] | None) -> Column:
    """Whether a phrase goes on over a slot: a question's pronoun follows, or one of the given phrases stands before."""
    asked = before.rlike(QUESTION + r"\s*\z") & after.rlike(PRONOUN)
    return asked | before.rlike(rf"(?i)(?:^|{SIDE}){any_of(continuing)}\s*\z") if continuing else asked


def _opens(after: Column, exempt: list[str] | None) -> Column:
    """Whether a text starts a sentence: a speaker change, ``I``, a title-case word, or upper-case before lower-case words;
    ``exempt`` words do not."""
    titled = after.rlike(OPENS)
    if exempt:
        titled = titled & ~after.rlike(rf"(?i)^\s*[\"'(\[]*{any_of(exempt)}\b")
    return after.rlike(r"^\s*>>") | titled


def format_punct(word: Column | str, before: Column | str, after: Column | str, continuing: list[str] | None = None, exempt: list[str] | None = None) -> Column:
    """The word with the sentence's end that follows it: a sign right after it, else a full stop where the text after
    starts a sentence, unless the phrase goes on. continuing: phrases after which it does; exempt: words that are written
    with a capital without starting a sentence."""
    before, after = _col(before), _col(after)
    sign = F.regexp_extract(after, r"^([.!?])", 1)
    stop = F.when(sign != "", sign).when(_opens(after, exempt) & ~_goes_on(before, after, continuing), ".").otherwise("")
    return F.concat(_col(word), F.when(_col(word).rlike(r"[.!?]\z"), "").otherwise(stop))


def virtual_break(before: Column | str, after: Column | str, continuing: list[str] | None = None, exempt: list[str] | None = None) -> Column:
    """Whether a sentence is taken to end at a slot: a speaker change or a title-case word follows, no stop stands
    there, the phrase does not go on, and no verb of going to a place stands before. That an exact rule spans the slot
    is seen where rules are matched (D6)."""
    before, after = _col(before), _col(after)
    guarded = after.rlike(r"^\s*[.!?]") | before.rlike(GO_TO) | _goes_on(before, after, continuing)
    return _opens(after, exempt) & ~guarded


def spoken_units(text: Column | str) -> Column:
    return F.regexp_count(normalize_mask(text), F.lit(UNIT))


def wilson_lower(k: Column | str, n: Column | str, z: float = 1.96) -> Column:
    """Lower bound of a share's 95 % interval; 0 without trials."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    p = k / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, bound).otherwise(0.0)


def rate(k: Column | str, n: Column | str) -> Column:
    """k / n, null without trials."""
    return F.when(_col(n) > 0, _col(k).cast("double") / _col(n))
