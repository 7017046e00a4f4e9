import hashlib
import random

import numpy as np
from cases import LONG, ODD, frame, row

from sentinela.llm import fingerprints
from sentinela.llm.fingerprints import K, S, anchors, compare_with_next, likeness, read, written


def plain_anchors(text):
    """Positions by the definition, s-mers ordered by the hash in use."""
    points = fingerprints.code_points(text)
    inner = fingerprints._rolling(points, S).tolist()
    return [i for i in range(len(points) - K + 1) if min(inner[i : i + K - S + 1]) in (inner[i], inner[i + K - S])]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop é") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_closed_syncmers():
    rng = random.Random(1)
    for n in (12, 30, 200):
        text = prose(rng, n)
        if len(text) >= K:
            want = plain_anchors(text)
            assert set(anchors(text)[1].tolist()) <= set(want)
            assert len(anchors(text)[1]) == len(set(fingerprints._rolling(fingerprints.code_points(text), K)[want].tolist())) or not want


def test_anchors_do_not_depend_on_context():
    rng = random.Random(2)
    passage = prose(rng, 120)
    one, two = anchors(prose(rng, 30) + passage), anchors(passage + prose(rng, 50))
    assert set(anchors(passage)[0].tolist()) <= set(one[0].tolist()) & set(two[0].tolist())


def test_short_uniform_and_empty_texts():
    assert written(anchors("")) == "" and likeness(anchors(""), anchors("")) == 1.0
    assert likeness(anchors(""), anchors("x")) == 0.0 and likeness(anchors("x"), anchors("x")) == 1.0
    assert likeness(anchors("x"), anchors("y")) == 0.0
    assert len(anchors("a" * 9000)[0]) == 1
    assert len(anchors(LONG)[0]) > 400
    back = read(written(anchors(LONG)))
    assert np.array_equal(back[0], anchors(LONG)[0]) and np.array_equal(back[1], anchors(LONG)[1])


def test_likeness_wants_the_same_order():
    rng = random.Random(3)
    a, b = prose(rng, 150), prose(rng, 150)
    assert 0.4 < likeness(anchors(a + b), anchors(b + a)) < 0.65
    assert likeness(anchors(a), anchors(a.replace(a.split()[70], "zzz", 1))) > 0.8


def check(spark, rows):
    got = compare_with_next(frame(spark, rows)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    for r in got:
        texts = {x[1] or "" for x in rows if x[0] == r.doc_id}
        k = [i for i, x in enumerate(ordered) if x[0] == r.doc_id]
        after = {ordered[(i + 1) % len(ordered)][1] or "" for i in k} | (texts if len(k) > 1 else set())
        assert r.edited_text in {t[: len(t) - len(t) // 3] + a[: len(t) // 3] for t in texts for a in after}
        assert r.fingerprint in {written(anchors(t)) for t in texts}
        assert r.edited_fingerprint == written(anchors(r.edited_text))
        assert r.near_edited == likeness(read(r.fingerprint), read(r.edited_fingerprint))
        assert r.near_next in {likeness(read(r.fingerprint), anchors(a)) for a in after}
        assert r.n_chars in {len(t) for t in texts}


def test_neighbours(spark, monkeypatch):
    check(spark, ODD)
    check(spark, [row(5, "alone")])
    rng = random.Random(4)
    monkeypatch.setattr(fingerprints, "PART_BYTES", 2000)
    check(spark, [row(rng.randrange(10**12), prose(rng, rng.randrange(1, 60))) for _ in range(150)])
    assert compare_with_next(frame(spark, [])).count() == 0


def test_hash_of_the_edited_text(spark):
    got = compare_with_next(frame(spark, [row(2, "áé" * 30), row(1, "xyz" * 30)])).orderBy("doc_id").collect()
    assert hashlib.sha256(got[1].edited_text.encode()).hexdigest() == hashlib.sha256(("áé" * 20 + "xyz" * 6 + "xy").encode()).hexdigest()


def test_edited_texts_share_an_anchor_at_every_length():
    rng = random.Random(7)
    for n in [*range(3, 130), 400]:
        for rest in (0, 1, n // 9, n // 3):
            text, other = prose(rng, n)[:n], prose(rng, n + 1)[:rest]
            edited = text[: n - n // 3] + other
            assert len(text) == n and likeness(anchors(text), anchors(edited)) > 0, (text, edited)
            assert likeness(anchors(text), anchors(text)) == 1.0


def test_close_edits_leave_an_anchor_between_them():
    rng = random.Random(8)
    for _ in range(50):
        a, b, kept = prose(rng, 30), prose(rng, 30), prose(rng, 20)[: 2 * K - S - 1]
        assert likeness(anchors(a + "#" + kept + "#" + b), anchors(prose(rng, 30) + "%" + kept + "%" + prose(rng, 30))) > 0


def plain_likeness(one, two):
    """Longest common subsequence of the anchors of the kinds both have, by the table."""
    kinds = [max((h & 3 for h in x), default=None) for x in (one, two)]
    if None in kinds:
        return float(kinds[0] == kinds[1])
    a, b = ([h for h in x if h & 3 <= min(kinds)] for x in (one, two))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(a) + len(b))


def test_likeness_against_the_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(150):
        a = prose(rng, rng.randrange(1, 30))[: rng.choice([3, 7, 8, 25, 29, 30, 31, 90])]
        cut = rng.randrange(len(a) + 1)
        b = rng.choice([a[cut:] + a[:cut], a[:cut] + "##" + a[cut:], a + "x", prose(rng, 9), ""])
        one, two = anchors(a), anchors(b)
        assert likeness(one, two) == plain_likeness(one[0].tolist(), two[0].tolist())


def test_a_code_point_more_changes_little_at_every_length():
    rng = random.Random(10)
    for n in range(10, 131):
        for _ in range(8):
            text = prose(rng, n)[:n]
            assert likeness(anchors(text), anchors(text + rng.choice("xyz."))) > 0.8, text


def test_rows_of_one_id_or_none_lie_in_many_parts(spark, monkeypatch):
    """A third of the rows have no id and half of these one text; another id has a fifth."""
    monkeypatch.setattr(fingerprints, "PART_BYTES", 3000)
    rng = random.Random(11)
    rows = [row(None, "one and the same text of some words" if i % 2 else prose(rng, 8)) for i in range(200)]
    rows += [row(77, prose(rng, 8)) for i in range(120)] + [row(1000 + i, prose(rng, 8)) for i in range(280)]
    seen = []
    true = fingerprints.part_of
    monkeypatch.setattr(fingerprints, "part_of", lambda s, w: seen.append((s, w)) or true(s, w))
    got = compare_with_next(frame(spark, rows)).collect()
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0), reverse=True)
    texts = {i: [r[1] for r in rows if r[0] == i] for i in ids}
    assert len(got) == 600
    follows = []
    for r in got:
        after = ids[(ids.index(r.doc_id) + 1) % len(ids)]
        follows.append(r.next_id)
        assert r.next_id in (r.doc_id, after)
        candidates = {t[: len(t) - len(t) // 3] + a[: len(t) // 3] for t in texts[r.doc_id] for a in texts[r.next_id]}
        assert r.edited_text in candidates
    # every row but the first of all is the next of just one
    assert follows.count(None) == 200 and follows.count(77) == 120
    splits, within = seen[0]
    frame_ = frame(spark, rows).selectExpr("doc_id", "coalesce(xxhash64(text), 0) AS order", "pmod(xxhash64(monotonically_increasing_id()), 1L << 40) AS tie")
    sizes = [r["count"] for r in frame_.groupBy(true(splits, within).alias("p")).count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 600 / len(sizes) * 4 and len(sizes) >= len(splits) * 0.8
