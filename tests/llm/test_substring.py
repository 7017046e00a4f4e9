import random
from collections import Counter

import numpy as np
from cases import ODD, frame, row, words

from sentinela.llm import substring_dedup
from sentinela.llm.substring_dedup import remove_repeated_passages


def expected(rows, width):
    texts = [words(r[1]) for r in rows]
    count = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((r[0], len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows, width):
    got = remove_repeated_passages(frame(spark, rows), width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == expected(rows, width)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed[:-1], r.removed[1:], strict=True))


def test_odd_rows(spark):
    check(spark, ODD, 5)
    check(spark, ODD, 35)


def test_shared_passages_over_chunks_and_ranges(spark, monkeypatch):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(120):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.randrange(6, 13)]
        rows.append(row(i, rng.choice([" ", "\n", " \t "]).join(w)))
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 900)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 4000)
    check(spark, rows, 4)


def test_empty_table(spark):
    assert remove_repeated_passages(frame(spark, [])).count() == 0


def test_window_hashes_do_not_cross_texts():
    from sentinela.llm.tokens import window_hashes, word_bounds, word_hashes

    data = np.frombuffer(b"a b ca b c", np.uint8)
    starts, ends, first = word_bounds(data, np.array([0, 5, 10]))
    where, hashes = window_hashes(word_hashes(data, starts, ends), first, 3)
    assert where.tolist() == [0, 3] and hashes[0] == hashes[1]
