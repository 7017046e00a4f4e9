import random
from collections import Counter

import numpy as np
from cases import ODD, frame, row, words

from sentinela.llm.quality_rules import STATISTICS, accuracies, estimate, judge, statistics


def expected(text):
    text = text or ""
    w = words(text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            again[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, sum(again))


def check(spark, rows):
    got = statistics(frame(spark, rows)).collect()
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str)
    assert have == sorted(((r[0], *expected(r[1])) for r in rows), key=str)


def test_statistics(spark):
    rng = random.Random(2)
    check(spark, ODD)
    check(spark, [row(i, "".join(rng.choice(["a", "b", " ", "\n", "é", "#", "ab ", "\r\n", "a a a ", "x\n"]) for _ in range(rng.randrange(90)))) for i in range(300)])


def test_rules_that_agree_are_trusted():
    rng = random.Random(7)
    patterns = Counter()
    finds = (0.95, 0.9, 0.8, 0.6)  # how often a rule rejects a bad text; it rejects one good text in two hundred
    for _ in range(5000):
        good = rng.random() < 0.8
        patterns[tuple((-1 if rng.random() < (0.005 if good else p) else 1) if rng.random() < 0.8 else 0 for p in finds)] += 1
    prior, rates = estimate(dict(patterns))
    assert abs(prior - 0.8) < 0.03
    assert all(abs(rates[0, k, 0] - p) < 0.06 for k, p in enumerate(finds))
    right = accuracies(prior, rates)
    assert right == sorted(right, reverse=True) and right[0] > 0.95
    assert estimate({})[0] == 0.5


def test_verdicts(spark):
    rng = random.Random(8)
    lexicon = [f"{a}{b}" for a in ("ta", "lo", "mer", "sin", "qua", "ve") for b in ("ro", "nal", "te", "dis", "mo", "ke", "lan")]
    prose = lambda n: " ".join(". ".join(" ".join(rng.choice(lexicon) for _ in range(9)).capitalize() for _ in range(n // 9)).split()) + "."
    rows = [row(i, "\n".join(prose(60) for _ in range(4))) for i in range(60)]
    rows += [row(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(90).split()) for _ in range(2))) for i in range(10)]
    rows += [row(200 + i, " | ".join(w + "#%" for w in prose(150).split())) for i in range(10)]
    rows += [row(300, "same same same " * 40), row(301, "too short"), row(302, None)]
    got = {r.doc_id: r for r in judge(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(r.kept for i, r in got.items() if i >= 100)
    assert got[300].base_failed and got[301].base_failed and got[302].base_failed
    assert judge(frame(spark, [])).count() == 0


def plain_votes(r):
    """The rules once more, one text at a time."""
    def vote(good, bad):
        return -1 if bad else 1 if good else 0
    n = r["n_words"]
    part = lambda a, b: r[a] / r[b] if r[b] else None
    def on(value, good, bad):
        return 0 if value is None else vote(good(value), bad(value))
    cased = r["n_upper"] + r["n_lower"]
    dup = part("n_dup_lines", "n_lines")
    return (
        vote(n >= 100, n < 80),
        on(part("n_repeat_words", "n_words"), lambda x: x <= 0.1, lambda x: x > 0.3),
        vote(r["n_lines"] > 1 and r["n_dup_lines"] == 0, (dup is not None and dup > 0.3) or r["n_lines"] == 1),
        on(part("n_symbols", "n_words"), lambda x: x <= 0.02, lambda x: x > 0.2),
        on(part("n_symbols", "word_chars"), lambda x: x <= 0.005, lambda x: x > 0.03),
        on(part("word_chars", "n_words"), lambda x: 3 <= x <= 9, lambda x: x < 2 or x > 15),
        on(r["n_upper"] / cased if cased else None, lambda x: x <= 0.15, lambda x: x > 0.4),
        on(part("n_letter_words", "n_words"), lambda x: x >= 0.95, lambda x: x < 0.85),
        on(part("n_stops", "n_words"), lambda x: 0.01 <= x <= 0.34, lambda x: x > 0.5 or x < 0.02),
    )


def plain_posteriors(votes, steps=100):
    """Expectation-maximisation text by text, without counted patterns or arrays."""
    good = [{0: 1.0, 1: 0.5}.get(sum(x < 0 for x in v), 0.0) for v in votes]
    for _ in range(steps):
        prior = min(max(sum(good) / len(good), 0.01), 0.99)
        rates = []
        for share, first in (([1 - g for g in good], (1, 1)), (good, (2, 200))):
            per_rule = []
            for k in range(len(votes[0])):
                bad, ok = (f + sum(s for v, s in zip(votes, share, strict=True) if v[k] == x) for f, x in zip(first, (-1, 1), strict=True))
                per_rule.append((bad / (bad + ok), ok / (bad + ok)))
            rates.append(per_rule)
        good = []
        for v in votes:
            one, two = prior, 1 - prior
            for k, x in enumerate(v):
                if x:
                    one *= rates[1][k][x > 0]
                    two *= rates[0][k][x > 0]
            good.append(one / (one + two))
    return good


def test_votes_estimate_and_posterior_against_plain_python(spark):
    rng = random.Random(12)
    kinds = ["word", "Word.", "WORD!", "x#", "| |", "$$ %", "y.", "longerword", "é", "12"]
    rows = [row(i, "".join(rng.choice(kinds[: rng.choice([2, 8, 10])]) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.choice([3, 60, 90, 150])))) for i in range(250)]
    rows += [row(1000, None), row(1001, ""), row(1002, "a a a")]
    got = judge(frame(spark, rows)).collect()
    votes = [plain_votes({s: r[s] for s in STATISTICS}) for r in got]
    assert votes == [tuple(r[c] for c in r.asDict() if c.startswith("vote_")) for r in got]
    for r, p in zip(got, plain_posteriors(votes), strict=True):
        assert abs(r.quality - p) < 1e-6
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_an_objection_counts_as_far_as_its_rule_is_right():
    """A rule that objects to a third of good texts keeps none of them out; two rules that agree on junk do."""
    patterns = {(1, 1, 1): 6000, (-1, 1, 1): 3000, (1, -1, -1): 600, (-1, -1, -1): 300, (1, -1, 1): 10, (0, 1, 1): 500}
    prior, rates = estimate(patterns)
    odds = lambda p: prior / (1 - prior) * np.prod([rates[1, k, int(x > 0)] / rates[0, k, int(x > 0)] for k, x in enumerate(p) if x])
    assert odds((-1, 1, 1)) > 1 > odds((1, -1, -1)) and abs(rates[1, 0, 0] - 1 / 3) < 0.02
    assert odds((-1, 1, 1)) > 1 and odds((0, 1, 1)) > 1 and abs(prior - 9500 / 10410) < 0.02
