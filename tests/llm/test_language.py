import random

import numpy as np
import pytest
from cases import ODD, frame, row

from sentinela.llm.language_id import UNKNOWN, family_of, identify, learn, ngram_features

SOUNDS = {"en": "th ing er ou wh ea", "de": "sch ung ei ch tz ie", "fr": "eau oi que tion ê è", "es": "ción os que ll ñ ado", "xx": "kwa zulu mba ngo pi ta"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [row(i, prose(rng, lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(rng.choices(list(SOUNDS), k=600))]


def test_held_out_texts(spark, rows):
    docs = frame(spark, rows)
    got = identify(docs, learn(docs.filter("doc_id % 3 > 0"))).collect()
    want = {r[0]: r[2] for r in rows}
    unseen = [r for r in got if r.doc_id % 3 == 0]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in unseen]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, rows):
    got = identify(frame(spark), learn(frame(spark, rows))).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == UNKNOWN and by_id[i].score == 0 for i in (1, 2, 3, 9))
    assert all(by_id[i].lang_pred in SOUNDS for i in (4, 5, 6, 8, 10, 11, 12))
    assert identify(frame(spark, []), None).count() == 0
    assert {r.lang_pred for r in identify(frame(spark), None).collect()} == {UNKNOWN}
    assert learn(frame(spark, [])) is None and learn(frame(spark, [row(1, "x", None)])) is None
    one = learn(frame(spark, [row(1, "only one language here", "en")]))
    assert {r.lang_pred for r in identify(frame(spark, [row(1, "whatever")]), one).collect()} == {"en"}


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Ab c1é ", "", "x", "Zürich  zürich", "!!"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    together = ngram_features(data, at)
    for k, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(together[k], ngram_features(own, np.array([0, len(own)]))[0])
    assert together[1].sum() == 0 and together[4].sum() == 0 and np.isclose((together[3] ** 2).sum(), 1)


def test_families():
    assert family_of("pt-BR") == "romance" and family_of("de") == family_of("en") and family_of("zz") == "zz"


def test_predictions_against_plain_votes(spark, rows):
    """The family of the largest margin, then a vote for each pair of its languages."""
    from math import exp

    model = learn(frame(spark, rows))
    got = {r.doc_id: r for r in identify(frame(spark, rows[:60]), model).collect()}
    for r in rows[:60]:
        data = np.frombuffer(r[1].encode(), np.uint8)
        x = ngram_features(data, np.array([0, len(data)]))[0].tolist()
        margin = lambda w: sum(a * b for a, b in zip(x, w[:-1].tolist(), strict=True)) + float(w[-1])  # noqa: E731, B023
        family = dict(zip(model.families, map(margin, model.by_family), strict=True))
        best = max(model.families, key=lambda f: family[f])  # noqa: B023
        own = [a for a in model.langs if family_of(a) == best]
        votes, total = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for (a, b), w in zip(model.pairs, model.by_pair, strict=True):
            a, b = model.langs[a], model.langs[b]
            if a in votes:
                m = margin(w)
                votes[a if m >= 0 else b] += 1
                total[a] += 1 / (1 + exp(-4 * m))
                total[b] += 1 - 1 / (1 + exp(-4 * m))
        share = {a: total[a] / (len(own) - 1) if len(own) > 1 else 1.0 for a in own}
        pick = max(own, key=lambda a: votes[a] + share[a] / 2)  # noqa: B023
        whole = exp(4 * family[best]) / sum(exp(4 * v) for v in family.values())
        assert got[r[0]].lang_pred == pick and abs(got[r[0]].score - whole * share[pick]) < 1e-4
