import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from cases import frame, row, words

import corpus_pipeline
from sentinela.llm.mixing import counted_words, source_plan
from sentinela.llm.secrets import KINDS, base_spans, novel_spans, novelty_meter


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(n))


def near_kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()), key=str)


def test_unlike_texts_of_one_id_are_decided_on_each_for_itself(spark):
    copied, unique = passage(1), passage(2)
    assert near_kept(spark, [row(1, copied), row(5, copied), row(5, unique)]) == [(1, copied), (5, unique)]


def test_near_copies_without_id_go(spark):
    a, b, c = passage(3), passage(4), passage(5)
    rows = [row(7, a), row(None, a + " one"), row(None, a + " two"), row(None, b), row(None, b + " one"), row(None, c), row(None, c)]
    kept = near_kept(spark, rows)
    assert (7, a) in kept and (None, c) in kept and len(kept) == 3
    assert sum(i is None and t.startswith(b) for i, t in kept) == 1


def test_near_copies_of_one_id_and_rows_without_words(spark):
    a = passage(6)
    rows = [row(3, a), row(3, a + " more"), row(4, None), row(4, ""), row(None, None), row(None, None), row(9, " ")]
    kept = near_kept(spark, rows)
    assert sum(i == 3 for i, _ in kept) == 1
    assert sorted((x for x in kept if x[0] != 3), key=str) == sorted([(4, None), (4, ""), (None, None), (9, " ")], key=str)


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_near_dedup(rows):
    """All pairs, then the smallest of each component by id, null ids last; of equal rows one."""
    rows = list({(r[0], r[1]): r for r in rows}.values())
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(rows[i])
    return list(members.values())


def plain_redacted(text):
    if not text:
        return text
    base = base_spans(text)
    out, done = "", 0
    for a, b, k in sorted(base + novel_spans(text, base, novelty_meter())):
        if b > done:
            out += text[done:a] + f"[{KINDS[k]}]" if a >= done else ""
            done = b
    return out + text[done:]


def test_the_whole_run_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    from sentinela.llm.queries import tokenizer_path

    rng = random.Random(21)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40))
    texts = [passage(100 + i, rng.choice([3, 20, 60, 300])) for i in range(40)]
    rows = [row(i, t, "en", "big" if i % 4 else "small") for i, t in enumerate(texts)]
    rows += [row(100 + i, texts[i] + " more", "en", "other") for i in range(0, 40, 5)]
    rows += [row(7, texts[7]), row(7, passage(500)), row(None, texts[8]), row(None, passage(501)), row(None, passage(501) + " x")]
    rows += [row(200, f"{passage(502)} password={key} end"), row(201, f"{passage(503)} the api key {key} stays"), row(202, None), row(203, ""), row(204, "word " * 9000)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    # labels of one kind: nothing to learn, all documents stay
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    hashes = {r.text: r.h for r in frame(spark, rows).selectExpr("text", "xxhash64(text) AS h").collect()}
    kept = [min(members, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]])) for members in plain_near_dedup(rows)]
    kept = [(*k[:1], plain_redacted(k[1]), *k[2:]) for k in kept]
    docs = frame(spark, kept)
    plan = {r.source: r for r in source_plan(counted_words(docs)).collect()}
    shown = Counter()
    for source, p in plan.items():
        own = [r for r in kept if r[3] == source]
        hashed = lambda r, t: int(hashlib.md5(f"pass:{'' if r[0] is None else r[0]}:{t}".encode()).hexdigest()[:15], 16)
        at, last = 0, -1
        for r in sorted(own, key=lambda r: (hashed(r, p.whole), r[0] or 0)):
            if at < p.rest:
                last = hashed(r, p.whole)
            at += len(words(r[1]))
        for r in own:
            shown[r[0], r[1]] += p.whole + (hashed(r, p.whole) <= last)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {k: np.array([*tokenizer.encode(k[1] or "", add_special_tokens=False).ids, 2], "<u4") for k in shown}
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == sum((Counter({(k[0], len(ids[k])): n}) for k, n in shown.items()), Counter())
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append(r)
        assert any(zlib.crc32(ids[k][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for k in shown if k[0] == r.doc_id and len(ids[k]) == r.doc_tokens)
    assert sum(r.length for r in pieces) == sum(len(ids[k]) * n for k, n in shown.items())
    last = max(by_sequence)
    for s, own in by_sequence.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == 4096 or s == last


def test_columns_of_the_documents_are_their_own(spark, tmp_path):
    """Columns named as the stages' own, and none that counts characters."""
    rows = [(i, passage(i), "s", 0.125, "h", "g", 7) for i in range(30)] + [(100 + i, "!!! ### " * 40, "s", 0.5, "h", "g", 7) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double, _hash string, _gone string, _gone_hash int")
    labels = [(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        assert {(r.score, r._hash, r._gone, r._gone_hash) for r in docs.collect()} <= {(0.125, "h", "g", 7), (0.5, "h", "g", 7)}
    left = {r.doc_id for r in docs.collect()}
    assert left <= set(range(30)) and len(left) >= 27
