import hashlib
import math
from collections import Counter, defaultdict

import pytest
from cases import ODD, frame, row, words

from sentinela.llm.mixing import counted_words, mix_sources, mixed_documents, source_plan


def plan_of(shares, entropy, most):
    def weights(a):
        raw = [q**a for q in shares]
        return [x / sum(raw) for x in raw]

    def mixed(a):
        return -sum(p * math.log(p) for p in weights(a)) / math.log(len(shares)) if len(shares) > 1 else 1.0

    grid = [i / 20000 for i in range(20001)]
    a = max((x for x in grid if mixed(x) >= entropy), default=0)
    b = min(x for x in grid if (max(shares) / min(shares)) ** (1 - x) <= most)
    return weights(max(a, b))


SIZES = {"hot": 3000, "mid": 500, "small": 60, "tiny": 9}


@pytest.fixture(scope="module")
def rows():
    out = []
    for s, n in SIZES.items():
        out += [row(len(out) + i, "w " * (1 + (7 * i) % 5), "en", s) for i in range(n)]
    return out


@pytest.mark.parametrize(("entropy", "most"), [(0.9, 1000.0), (0.0, 1000.0), (0.8, 3.0), (1.0, 5000.0)])
def test_weights(spark, rows, entropy, most):
    plan = {r.source: r for r in source_plan(counted_words(frame(spark, rows)), entropy, most).collect()}
    names = sorted(plan)
    total = sum(r.tokens for r in plan.values())
    want = plan_of([plan[s].tokens / total for s in names], entropy, most)
    assert all(abs(plan[s].weight - w) < 2e-3 for s, w in zip(names, want, strict=True))
    assert min(r.budget / r.tokens for r in plan.values()) == 1
    assert max(r.budget / r.tokens for r in plan.values()) <= most * 1.01
    assert all(r.budget == r.whole * r.tokens + r.rest for r in plan.values())


@pytest.mark.parametrize("budget", [None, 2000, 12_345])
def test_passes_against_brute_force(spark, rows, budget):
    docs = frame(spark, rows)
    got = mix_sources(docs, 0.95, 6.0, budget, block_tokens=500).collect()
    plan = {r.source: r for r in source_plan(counted_words(docs), 0.95, 6.0, budget).collect()}
    shown = defaultdict(list)
    for r in got:
        shown[r.source].append(r)
    blocks = max(1, math.ceil(sum(p.budget for p in plan.values()) / 500))
    for s, p in plan.items():
        own = [(r[0], len(words(r[1]))) for r in rows if r[3] == s]
        want, start = [], 0
        for turn in range(p.whole + 1):
            start = turn * p.tokens
            place = lambda i: int(hashlib.md5(f"pass:{i}:{turn}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
            for i, n in sorted(own, key=lambda x: (place(x[0]), x[0])):
                if start < p.budget:
                    want.append((i, turn, start, math.floor(start / p.budget * blocks)))
                start += n
        assert sorted((r.doc_id, r["pass"], r.start, r.block) for r in shown[s]) == sorted(want)
    slots = defaultdict(list)
    for r in got:
        slots[r.block].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for s, p in plan.items():
        per_block = Counter()
        for r in shown[s]:
            per_block[r.block] += r.n_tokens
        assert all(abs(n - p.budget / blocks) <= 6 for n in per_block.values())


def test_documents_of_the_mixture(spark, rows):
    docs = frame(spark, rows)
    got = mixed_documents(docs, entropy=0.9, max_passes=4.0)
    assert got.columns == docs.columns
    times = Counter(r.doc_id for r in got.collect())
    want = Counter(r.doc_id for r in mix_sources(docs, 0.9, 4.0).collect())
    assert times == want and set(times) == {r[0] for r in rows}


def test_odd_rows(spark):
    got = mix_sources(frame(spark)).collect()
    assert {r.source for r in got} == {"", "a", "b", "c"}
    assert {r.doc_id for r in got} == {r[0] for r in ODD}
    assert {r.doc_id for r in mixed_documents(frame(spark)).collect()} == {r[0] for r in ODD}
    assert mix_sources(frame(spark, [])).count() == 0 and mixed_documents(frame(spark, [])).count() == 0
    none = frame(spark, [row(1, None), row(2, "")])
    assert mix_sources(none).count() == 0
    single = mix_sources(frame(spark, [row(i, "a b c") for i in range(9)])).collect()
    assert Counter(r.doc_id for r in single) == Counter(range(9))


def test_texts_without_tokens_at_the_end_of_the_last_pass(spark):
    """Of ten empty texts some come after the last one with words in every hash order."""
    for k in range(6):
        docs = [row(100 * k + i, "a b c" if i % 20 < 9 else ("" if i % 2 else None), source="s") for i in range(20)]
        docs += [row(100 * k + 20 + i, "w " * 50 if i < 30 else "", source="big") for i in range(60)]
        got = mix_sources(frame(spark, docs), block_tokens=7).collect()
        assert {r.doc_id for r in got} == {r[0] for r in docs}
        whole = Counter(r.doc_id for r in got)
        assert all(whole[r[0]] >= 1 for r in docs) and whole == Counter(r.doc_id for r in mixed_documents(frame(spark, docs)).collect())
        assert max(r.block for r in got) < math.ceil(sum(p.budget for p in source_plan(counted_words(frame(spark, docs))).collect()) / 7)


def test_thousands_of_sources_stay_rows(spark):
    docs = [row(i, "w " * (1 + i % 7), source=f"host{i % 3000}") for i in range(9000)]
    plan = source_plan(counted_words(frame(spark, docs)))
    assert plan.count() == 3000 and abs(plan.agg({"weight": "sum"}).first()[0] - 1) < 1e-9
    assert "Broadcast" not in mix_sources(frame(spark, docs))._jdf.queryExecution().logical().toString()


def test_no_python_in_the_plan(spark, rows):
    plan = mix_sources(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
