import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import ODD, frame, row
from hypothesis import given, settings
from hypothesis import strategies as st

from sentinela.llm.queries import tokenizer_path
from sentinela.llm.vector_packing import WEIGHTS, best_fit, byte_encoder, pack_best_fit

PATH = tokenizer_path("byte_bpe_50k.json")


def sequences(plan):
    return [sorted(x for n, c in content for x in [n] * c) for bins, content in plan.kinds for _ in range(bins)]


def item_by_item(lengths, capacities, weights, rule):
    """Vector best fit, one piece at a time; equal scores go to the sequence that was chosen last, then the first."""
    bins, last = [], None
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        fits = [b for b in bins if all(x >= y for x, y in zip(b["left"], need, strict=True))]
        def score(b):
            share = [x / c for x, c in zip(b["left"], capacities, strict=True)]
            want = [y / c for y, c in zip(need, capacities, strict=True)]
            if rule == "norm":
                return sum(w * (s - y) ** 2 for w, s, y in zip(weights, share, want, strict=True))
            return sum(w * s * y for w, s, y in zip(weights, share, want, strict=True))
        if last in fits and last["size"] == n:
            best = last
        elif fits:
            best = min(fits, key=score)
        else:
            best = {"left": capacities, "items": []}
            bins.append(best)
        best["left"] = tuple(x - y for x, y in zip(best["left"], need, strict=True))
        best["items"].append(n)
        best["size"] = n
        last = best
    return bins


def check_plan(counts, capacities, rule="norm"):
    plan = best_fit(counts, capacities, WEIGHTS, rule)
    made = sequences(plan)
    assert Counter(x for s in made for x in s) == Counter({n: c for n, c in counts.items() if c})
    for s in made:
        assert sum(s) <= capacities[0] and len(s) <= capacities[1] and sum(x * x for x in s) <= capacities[2]
    return plan, made


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=15), st.integers(2, 12), st.integers(1600, 4000), st.sampled_from(["norm", "dot"]))
def test_plans_hold_every_capacity(counts, documents, attention, rule):
    plan, made = check_plan(counts, (60, documents, attention), rule)
    places = set()
    for n, c in counts.items():
        if c:
            at = plan.place(n, np.arange(c))
            for s, o, t, d in zip(at["sequence_id"].tolist(), at["offset"].tolist(), at["sequence_tokens"].tolist(), at["sequence_documents"].tolist(), strict=True):
                assert (sum(made[s]), len(made[s])) == (t, d)
                places |= {(s, o + k) for k in range(n)}
    assert len(places) == sum(n * c for n, c in counts.items())  # no token of a sequence is taken twice
    assert all((s, o) in places for s, items in enumerate(made) for o in range(sum(items)))  # and there is no gap


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_as_few_sequences_as_item_by_item(rule):
    rng = random.Random(4)
    for _ in range(30):
        lengths = [min(100, int(rng.expovariate(1 / 25)) + 1) for _ in range(rng.randrange(1, 400))]
        for capacities in [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 10_001)]:
            _, made = check_plan(Counter(lengths), capacities, rule)
            assert len(made) <= len(item_by_item(lengths, capacities, WEIGHTS, rule)) + 1


def test_many_texts_are_packed_near_the_bound():
    rng = random.Random(8)
    counts = Counter(rng.randrange(1, 1025) for _ in range(200_000))
    plan, made = check_plan(counts, (1024, 1024, 1024**2))
    assert len(made) <= 1.003 * sum(n * c for n, c in counts.items()) / 1024
    assert len(plan.kinds) <= 3 * 1024


def test_a_capacity_that_no_piece_fits():
    with pytest.raises(ValueError, match="does not fit"):
        best_fit({50: 1}, (60, 2, 2000))


def test_ids_against_the_whole_tokenizer():
    from tokenizers import Tokenizer

    texts = [r[1] or "" for r in ODD] + [
        "it's we'll they've I'm 'd 's x'sy ''re", "a  b   c \n\n d\t\te \r\n", "x<|endoftext|>y", "tabs\t\tand no-break", "“quoted” – dash… €5",
        "naïve Ærø 12½ ª º µ", "日本語 text", " lead", "trail ", "  ", "\n", "_under_score 3.14e-5 #!?"]
    rng = random.Random(2)
    texts += ["".join(rng.choice("ab 'sé1\n\t.?“ ") for _ in range(60)) for _ in range(300)]
    tokenizer = Tokenizer.from_file(PATH)
    encode = byte_encoder(PATH)
    for _ in range(2):
        assert encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(spark, rows, **given):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    length = given.get("length", 1024)
    got = pack_best_fit(frame(spark, rows), PATH, **given).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = Counter((r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows)
    have = Counter()
    for doc_id, pieces in by_doc.items():
        copies = sum(k for (d, _), k in want.items() if d == doc_id)
        if copies == 1:
            pieces.sort(key=lambda r: r.piece)
            assert [r.piece for r in pieces] == list(range(len(pieces)))
            assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
            assert all(r.length == length for r in pieces[1:]) and all(r.doc_tokens == sum(x.length for x in pieces) for r in pieces)
            have[doc_id, b"".join(r.ids for r in pieces)] += 1
    assert have == Counter({k: v for k, v in want.items() if sum(n for (d, _), n in want.items() if d == k[0]) == 1})
    assert sum(r.length for r in got) == sum(len(b) // 4 * n for (_, b), n in want.items())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        total = sum(r.length for r in pieces)
        assert total <= length and {(r.sequence_tokens, r.sequence_documents) for r in pieces} == {(total, len(pieces))}
        assert len(pieces) <= given.get("documents", length) and sum(r.length**2 for r in pieces) <= given.get("attention", length**2)
    return len(by_sequence), sum(r.length for r in got)


def test_odd_rows(spark):
    check(spark, ODD)
    check(spark, ODD, length=16, documents=3, attention=256, rule="dot")


def test_full_pieces_and_tails_of_one_length(spark):
    rows = [row(i, " a" * n) for i, n in enumerate([7, 15, 7, 8, 23, 6, 0, 15, 31, 7, 7, 7, 1, 2])]
    n, total = check(spark, rows, length=8)
    assert n == -(-total // 8)


def test_empty_table(spark):
    assert pack_best_fit(frame(spark, []), PATH).count() == 0
