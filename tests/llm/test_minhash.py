import random

import pytest
from cases import LONG, ODD, frame, row, words

from sentinela.llm import minhash_join
from sentinela.llm.components import components
from sentinela.llm.minhash_join import near_duplicates


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def expected(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(top(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        least = min((x for x in ids[top(i)] if x is not None), default=None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(out, key=str)


def check(spark, rows):
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == expected(rows)


def varied(rng, words_, edits):
    w = list(words_)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
    return " ".join(w)


def test_odd_rows(spark):
    check(spark, ODD)


def test_chains_borders_and_common_lines(spark):
    rng = random.Random(5)
    line = [f"l{i}" for i in range(14)]
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for c in range(8):
            rows.append(row(1000 * g + c, varied(rng, line + base if g % 2 else base, rng.randrange(4)).upper() if c % 3 == 0 else varied(rng, base, rng.randrange(4))))
    rows += [row(50_000 + i, " ".join(line + [f"s{i}a{j}" for j in range(rng.randrange(2, 12))])) for i in range(60)]
    # 75 of 100 shingles in common: just enough; 74: not
    base = [f"e{i}" for i in range(91)]
    rows += [row(60_000, " ".join(base)), row(60_001, " ".join(base[:79] + [f"f{i}" for i in range(12)])), row(60_002, " ".join(base[:78] + [f"h{i}" for i in range(13)]))]
    rng.shuffle(rows)
    check(spark, rows)


def test_large_group_with_long_lists(spark, monkeypatch):
    """More copies than a short list may hold: they meet in long lists only."""
    monkeypatch.setattr(minhash_join, "LONG", 6)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(50)]
    rows = [row(i, varied(rng, base, rng.randrange(9))) for i in range(90)]
    rows += [row(500 + i, " ".join(base[:8] + [f"o{i}x{j}" for j in range(5)])) for i in range(40)]
    rng.shuffle(rows)
    check(spark, rows)


def test_empty_table_and_low_threshold(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(frame(spark), percent=50)
    assert len(shingles(LONG)) > 900


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (61, None)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in pairs:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
