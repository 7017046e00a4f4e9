import random

import numpy as np
from cases import LONG, ODD, frame, row, words
from hypothesis import given, settings
from hypothesis import strategies as st

from sentinela.llm import periodic_runs
from sentinela.llm.periodic_runs import detect_runs, find_runs, scales, window_least


def plain_runs(w):
    """Every lag, every place."""
    n, found = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(w, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def values(*texts):
    """Texts end to end, with values that no two share."""
    n = np.array([len(t) for t in texts])
    ids = {x: k for k, x in enumerate(dict.fromkeys((i, x) for i, t in enumerate(texts) for x in t))}
    flat = np.array([ids[i, x] for i, t in enumerate(texts) for x in t], np.uint64)
    return periodic_runs.mix(flat * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), n


def planted(rng, n, alphabet):
    w = [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 3))
        end = min(n, a + int(p * rng.uniform(2, 7)) + rng.randrange(3))
        for i in range(a + p, end):
            w[i] = w[i - p]
    return w


def test_every_length_and_period_against_plain_search():
    rng = random.Random(5)
    for trial in range(250):
        texts = [planted(rng, rng.choice([1, 5, 23, 24, 25, 30, 60, 150, 400]), rng.choice([1, 2, 3, 50, 10**6])) for _ in range(4)]
        v, n = values(*texts)
        ends = np.cumsum(n)
        got = [[] for _ in texts]
        for s, length, p in find_runs(v, n):
            k = int(np.searchsorted(ends, s, "right"))
            got[k].append((s - int(ends[k] - n[k]), length, p))
        assert got == [plain_runs(t) for t in texts], trial


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 30), st.integers(24, 120))
def test_runs_in_small_alphabets(noise, p, length):
    base = (noise + [7] * p)[:p]
    w = noise + [base[i % p] for i in range(length)] + noise[::-1]
    v, n = values(w)
    assert find_runs(v, n) == plain_runs(w)


def test_exactly_three_periods_at_every_scale():
    rng = random.Random(1)
    for p in [*range(9, 130), 333, 500]:
        base = [rng.randrange(10**6) for _ in range(p)]
        for short in (0, 1):
            w = [-1, *(base * 3)[: 3 * p - short], -2]
            v, n = values(w)
            assert find_runs(v, n) == ([] if short else [(1, 3 * p, p)]), p


def test_scales_cover_all_periods_without_gap():
    covered = []
    for first, last, size, window in scales(100_000):
        assert size >= last - 1 and 1 <= window <= 2 * first - size + 1
        covered += range(first, last + 1)
    assert covered == list(range(9, len(covered) + 9)) and covered[-1] * 3 >= 100_000 - 3


def test_least_of_windows():
    rng = np.random.default_rng(2)
    for n, width in [(1, 1), (7, 3), (9, 3), (50, 7), (50, 50)]:
        keys = rng.integers(0, 9, n).astype(np.uint64)
        assert window_least(keys, width).tolist() == [min(keys[i : i + width]) for i in range(n - width + 1)]


def test_odd_rows(spark):
    line = "x y z " * 40
    rows = [*ODD, row(20, line), row(20, line), row(21, "a\n" * 23), row(22, "a\n" * 24), row(23, "b " * 5 + line + " é " * 30)]
    got = sorted(detect_runs(frame(spark, rows)).collect(), key=str)
    want = []
    for r in rows:
        w = words(r[1])
        runs = plain_runs(w) if r[1] != LONG else [(0, 30_000, 977)]
        kept = collapsed(w, runs)
        want.append((r[0], len(w), runs, len(w) - len(kept.split(" ") if kept else []), kept))
    have = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.n_dropped, r.collapsed_text) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert detect_runs(frame(spark, [])).count() == 0


def test_work_grows_with_the_text_and_not_its_square():
    import time

    rng = random.Random(9)
    def took(n):
        w = [rng.randrange(300) for _ in range(n)]
        for i in range(n // 4, n):
            w[i] = w[i - n // 8]
        v, count = values(w)
        begin = time.perf_counter()
        assert (n // 8, n - n // 8, n // 8) in find_runs(v, count) or len(find_runs(v, count)) >= 1
        return time.perf_counter() - begin

    took(1000)
    assert took(160_000) < 60 * max(took(10_000), 0.002)


def test_planted_runs_against_plain_python(spark):
    import zlib

    from sentinela.llm.queries import with_planted_runs

    rng = random.Random(3)
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:60] + [1, 2, 3]
    texts = [None, "", " \n", "one", "two words"] + [" ".join(rng.choices("abcdefgh", k=n)) for n in range(3, 61)]
    rows = [row(i, t) for i, t in zip(ids, texts, strict=True)] + [row(None, "no id here"), row(ids[5], "again\tthe  same id")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in with_planted_runs(frame(spark, rows)).collect())
    want = []
    for r in rows:
        h, w = zlib.crc32(str(r[0]).encode()), words(r[1])
        text = r[1] or ""
        if r[0] is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(w[i if i < a else a + (i - a) % p] for i in range(len(w)))
        want.append((-1 if r[0] is None else r[0], text))
    assert got == sorted(want)
