"""Greedy selection and its gate against plain loops, class patterns and word choice on fixed cases."""

import math
import random
from collections import Counter

import pytest

from slotloom.operators import greedy, mining


def test_selection_goes_on(spark):
    hits = [(f"p{i:02}", "a", 10 * i + k, "a") for i in range(25) for k in range(2)] + [("q", "a", 999, "a")]
    df = spark.createDataFrame(hits, "pattern string, word string, row_id long, expected string")
    rows = mining.greedy_select(df).orderBy("rank").collect()
    assert [(r.rank, r.pattern, r.correct, r.wrong) for r in rows] == [(i, f"p{i:02}", 2, 0) for i in range(25)]
    assert mining.greedy_select(df, most=3).count() == 3


def test_class_patterns_take_up_to_two_tokens(spark):
    tagged = spark.createDataFrame([(1, -2, "<BOS>", None), (1, -1, "in", "place"), (1, 1, "end", None), (1, 2, "now", None), (2, -1, "<BOS>", None), (2, 1, "<EOS>", None)], "row_id long, off int, tok string, cls string")
    got = {r.pattern for r in mining.class_patterns(tagged).collect()}
    assert got == {"in []", "<place> []", "[] end", "[] end now", "in [] end", "<place> [] end", "in [] end now", "<place> [] end now"}


def test_word_choice_gates(spark):
    rows = [("p", 0, "manual", "a", f"c{i % 3}") for i in range(40)] + [("q", 0, "manual", "a", f"c{i % 3}") for i in range(5)]
    rows += [("r", 0, "manual", "a", f"c{i % 3}") for i in range(40)] + [("r", 0, "discovery", "b", f"c{i % 3}") for i in range(9)]
    rows += [("p", 0, "manual", None, "c0")] * 90
    df = spark.createDataFrame(rows, "pattern string, half int, tier string, expected string, creator string")
    got = {(r.pattern, r.tier): (r.word, r.total, r.passes) for r in mining.word_choice(df).collect()}
    # Five of five have a lower bound of 0.57; r's word is contradicted in the other tier; rows without a label do not count.
    assert got == {("p", "manual"): ("a", 40, True), ("q", "manual"): ("a", 5, False), ("r", "manual"): ("a", 40, False), ("r", "discovery"): ("b", 9, True)}


def plain_passes(g, tier, n, right, people, other, other_right):
    if n < g.times or right / n < g.share or people < g.creators:
        return False
    if tier != g.strict:
        return True
    p, z = right / n, 1.96
    bound = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return bound >= g.lower and (other < g.times or other_right / other >= g.share)


def plain_stats(g, rows, tier, word):
    own, other = [r for r in rows if r["tier"] == tier], [r for r in rows if r["tier"] != g.strict]
    right = [r for r in own if r["expected"] == word]
    return plain_passes(g, tier, len(own), len(right), len({r["creator"] for r in right}), len(other), sum(r["expected"] == word for r in other))


def plain_choice(g, rows):
    for tier in g.tiers:
        words = Counter(r["expected"] for r in rows if r["tier"] == tier)
        if words:
            word = min(words, key=lambda w: (-words[w], w))
            if plain_stats(g, rows, tier, word):
                return word, tier
    return None


def plain_gate(g, rows, left):
    choice = plain_choice(g, rows)
    halves = [[r for r in rows if r["half"] == h] for h in (0, 1)]
    if not choice or any(plain_choice(g, h) != choice for h in halves):
        return None
    word, tier = choice
    return choice if all(plain_stats(g, part, tier, word) for part in (left, *([r for r in left if r["half"] == h] for h in (0, 1)))) else None


def plain_greedy(g, patterns, least=2, cost=3):
    """patterns: {pattern: rows}; the choice one pattern at a time, each gated anew on the rows left."""
    open_ = lambda rows, covered: [r for r in rows if r["predicted"] is None and r["row_id"] not in covered]
    pool = {p: c for p, rows in patterns.items() if (c := plain_gate(g, rows, open_(rows, set())))}
    covered, out = set(), []
    while True:
        best = None
        for p, (word, tier) in pool.items():
            left = open_(patterns[p], covered)
            own = [r["expected"] == word for r in left if r["tier"] == tier]
            score = sum(own) - cost * (len(own) - sum(own))
            key = (g.tiers.index(tier), -score, p)
            if score >= least and (best is None or key < best[0]) and plain_gate(g, patterns[p], left):
                best = key, p, word, tier, score, left
        if best is None:
            return out
        _, p, word, tier, score, left = best
        right = sum(r["expected"] == word for r in left)
        out.append((len(out), p, word, tier, score, right, len(left) - right))
        covered |= {r["row_id"] for r in left}
        del pool[p]


@pytest.mark.parametrize("seed, share, lower, creators", [(1, 0.5, 0.1, 2), (2, 0.7, 0.3, 2), (3, 0.6, 0.2, 1)])
def test_greedy_selection_against_a_plain_loop(spark, seed, share, lower, creators):
    """Overlapping patterns over rows of two tiers, with labels that mostly follow one of a row's patterns."""
    rng, rows = random.Random(seed), []
    word_of = {f"p{i:02}": rng.choice("abc") for i in range(36)}
    for i in range(1800):
        label, creator = rng.choice("abc"), rng.randrange(12)
        alike = [p for p, w in word_of.items() if w == label]
        own = set(rng.sample(alike, 1 + (rng.random() < 0.3))) | ({rng.choice(sorted(word_of))} if rng.random() < 0.06 else set())
        label = label if rng.random() < 0.93 else rng.choice("abc")
        row = {"row_id": i, "half": creator % 2, "tier": rng.choice(["discovery", "manual", "manual", "odd"]), "expected": label if rng.random() < 0.95 else None, "creator": f"c{creator}", "predicted": "x" if rng.random() < 0.2 else None}
        rows += [{"pattern": p, **row} for p in sorted(own)]
    gate = mining.Gate(share=share, lower=lower, creators=creators)
    df = spark.createDataFrame(rows, "pattern string, row_id long, half int, tier string, expected string, creator string, predicted string")
    known = {}
    for r in rows:
        if r["expected"] is not None and r["tier"] in gate.tiers:
            known.setdefault(r["pattern"], []).append(r)
    want_gate = sorted((p, *c) for p, own in known.items() if (c := plain_gate(gate, own, [r for r in own if r["predicted"] is None])))
    assert want_gate and sorted(map(tuple, mining.creator_gate(df, gate).collect())) == want_gate
    rounds = []
    got = mining.greedy_select(mining.gated_hits(df, gate), gate=gate, rounds=rounds).orderBy("rank").collect()
    assert [tuple(r) for r in got] == plain_greedy(gate, known)
    assert sum(rounds) == len(got) > 4 and len(rounds) < len(got)


def test_selection_without_a_gate_against_a_plain_loop(spark):
    rng = random.Random(6)
    for _ in range(3):
        hits = [(f"p{p:02}", "ab"[p % 2], r, rng.choice(["a", "a", "b", None])) for p in range(14) for r in rng.sample(range(90), 12)]
        label = {r: e for *_, r, e in hits}
        hits = [(p, w, r, label[r]) for p, w, r, _ in hits]
        covered, want = set(), []
        while True:
            scores = {}
            for p, w, r, e in hits:
                if r not in covered:
                    scores[p, w] = scores.get((p, w), 0) + (1 if e == w else -3)
            best = min(((-s, p) for (p, _), s in scores.items() if s >= 2), default=None)
            if best is None:
                break
            want.append((best[1], -best[0]))
            covered |= {r for p, _, r, _ in hits if p == best[1]}
        got = mining.greedy_select(spark.createDataFrame(hits, "pattern string, word string, row_id long, expected string")).orderBy("rank").collect()
        assert [(r.pattern, r.score) for r in got] == want


def test_nothing_to_select(spark):
    none = spark.createDataFrame([], "pattern string, row_id long, half int, tier string, expected string, creator string, predicted string")
    assert mining.greedy_select(mining.gated_hits(none), gate=mining.Gate()).count() == 0


def test_a_chain_of_patterns_takes_one_pass(spark):
    """Each pattern shares a row with the next one, which is a little worse: none but the first stands above its neighbours."""
    hits = [(f"p{i:02}", "a", 100 * i + k, "a") for i in range(20) for k in range(60 - 2 * i)] + [(f"p{i + 1:02}", "a", 100 * i, "a") for i in range(19)]
    rounds = []
    got = mining.greedy_select(spark.createDataFrame(hits, "pattern string, word string, row_id long, expected string"), rounds=rounds).orderBy("rank").collect()
    assert [(r.pattern, r.score) for r in got] == [(f"p{i:02}", 60 - 2 * i) for i in range(20)]
    assert rounds == [20]


@pytest.mark.parametrize("seed, held, broadcast", [(4, 0, 1 << 18), (4, 120, 1 << 18), (5, 60, 0), (5, 1 << 21, 1 << 18)])
def test_rounds_and_levels_take_the_same(spark, monkeypatch, seed, held, broadcast):
    """Many equal rows and few creators, with no, some and all matches held by the driver."""
    monkeypatch.setattr(greedy, "PATTERNS", broadcast)
    rng, rows = random.Random(seed), []
    word_of = {f"p{i:02}": rng.choice("ab") for i in range(30)}
    for i in range(1500):
        label, creator, first = rng.choice("ab"), rng.randrange(5), rng.randrange(15)
        near = [p for p in sorted(word_of)[first : first + 6] if word_of[p] == label]
        own = set(near[: 1 + rng.randrange(3)]) | ({rng.choice(sorted(word_of))} if rng.random() < 0.03 else set())
        row = {"row_id": i, "half": creator % 2, "tier": "manual" if i % 3 else "discovery", "expected": label, "creator": f"c{creator}", "predicted": None}
        rows += [{"pattern": p, **row} for p in sorted(own)]
    gate, known = mining.Gate(share=0.6, lower=0.2), {}
    for r in rows:
        known.setdefault(r["pattern"], []).append(r)
    df = spark.createDataFrame(rows, "pattern string, row_id long, half int, tier string, expected string, creator string, predicted string")
    rounds = []
    got = mining.greedy_select(mining.gated_hits(df, gate), gate=gate, rounds=rounds, held=held).orderBy("rank").collect()
    assert [tuple(r) for r in got] == plain_greedy(gate, known) and sum(rounds) == len(got) > 4
    assert len(rounds) <= len(gate.tiers) if held == 1 << 21 else len(rounds) > len(gate.tiers)
