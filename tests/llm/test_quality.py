import random

import numpy as np
from cases import ODD, frame, row

from sentinela.llm.quality_mil import AttentionModel, learn, passages, score_texts


def texts(n):
    rng = random.Random(12)
    syllables = "ta lo mer sin qua ve ro nal te dis mo ke".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        good = " ".join(word() for _ in range(rng.randrange(20, 300))).capitalize() + "."
        label = int(rng.random() < 0.7)
        if not label:
            kind = i % 3
            junk = [" ".join([word()] * 70), " ".join(word().upper() + "!!" for _ in range(70)), " | ".join(word() for _ in range(70))][kind]
            good = good + "\n" + junk if rng.random() < 0.5 else junk
        rows.append(row(i, good))
        labels.append((i, label, 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = texts(700)
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = learn(frame(spark, rows), marked.filter("doc_id % 4 <> 2"))
    got = score_texts(frame(spark, rows), model, ["doc_id", "text"]).collect()
    want = dict((a, b) for a, b, _ in labels)
    assert np.mean([(r.score >= 0.5) == want[r.doc_id] for r in got if r.doc_id % 4 == 2]) > 0.95
    again = learn(frame(spark, rows), marked.filter("doc_id % 4 <> 2"))
    assert {r.doc_id: r.score for r in score_texts(frame(spark, rows), again).collect()} == {r.doc_id: r.score for r in got}
    odd = score_texts(frame(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    empty = {r.score for r in odd if r.text is None or not r.text.strip()}
    assert len(empty) == 1
    assert score_texts(frame(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    one = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (1, 0, 0), (77, 0, 1), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    assert learn(frame(spark), one) is None
    assert learn(frame(spark, []), one.limit(0)) is None
    assert {r.score for r in score_texts(frame(spark), None).collect()} == {0.5}


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    bags = [3, 1, 5]
    cut = np.cumsum([0, *bags])
    from sentinela.llm.quality_mil import FEATURES

    x, label = rng.normal(size=(9, FEATURES)), np.array([1.0, 0, 1])
    model = AttentionModel()
    found = model.gradients(model.forward(x, cut), cut, label)

    def loss():
        p = model.forward(x, cut)["score"]
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    for name, w in model.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            down = loss()
            w[at] = keep
            assert abs((up - down) / 2e-5 - found[name][at]) < 1e-6


def test_passages_of_a_text_do_not_depend_on_its_neighbours():
    parts = ["One two THREE!!", "", " \n", "a " * 200, "é|#"]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in parts)])
    x, cut = passages(data, at)
    assert np.diff(cut).tolist() == [1, 1, 1, 4, 1]
    for k, t in enumerate(parts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(x[cut[k] : cut[k + 1]], passages(own, np.array([0, len(own)]))[0], atol=1e-6)


def test_scores_against_a_plain_forward_pass(spark):
    """Passage by passage and number by number, with softmax and sums written out."""
    from math import exp, tanh

    from sentinela.llm.quality_mil import FEATURES, GATE, HIDDEN

    rows, labels = texts(120)
    model = learn(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    w = {k: v.tolist() for k, v in model.w.items()}
    sigmoid = lambda x: 1 / (1 + exp(-x))
    for r in score_texts(frame(spark, [*rows[:12], *ODD[:5]]), model, ["doc_id", "text"]).collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        found, _ = passages(data, np.array([0, len(data)]))
        encoded, raw = [], []
        for x in found.tolist():
            x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, model.mean.tolist(), model.spread.tolist(), strict=True)]
            z = [tanh(w["bias"][j] + sum(x[i] * w["encode"][i][j] for i in range(FEATURES))) for j in range(HIDDEN)]
            gates = [tanh(sum(z[i] * w["tanh"][i][j] for i in range(HIDDEN))) * sigmoid(sum(z[i] * w["gate"][i][j] for i in range(HIDDEN))) for j in range(GATE)]
            encoded.append(z)
            raw.append(sum(g * a for g, a in zip(gates, w["attend"], strict=True)))
        weights = [exp(a) / sum(map(exp, raw)) for a in raw]
        bag = [sum(a * z[j] for a, z in zip(weights, encoded, strict=True)) for j in range(HIDDEN)]
        assert abs(r.score - sigmoid(w["out_bias"][0] + sum(b * o for b, o in zip(bag, w["out"], strict=True)))) < 2e-6
