"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words. Each passage is encoded by what can be counted in it; a small network turns
the counts into a representation, gated attention (tanh times sigmoid) weighs the passages, and the weighted mean is scored.
Only labels of whole texts are needed to learn both. It is fitted on a bounded sample of labelled texts, and scores every
text whole, in tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sentinela.llm.common import passes
from sentinela.llm.tokens import LOWER, mix, salts, window_hashes, word_bounds, word_hashes

PASSAGE = 64
SAMPLE = 6000
BUCKETS = 64
HIDDEN = 24
GATE = 12
LEAST_STEPS = 600
MARKS = [b"!", b"?", b".,;:", b"|", b"#*$%&", b"<>[]{}()", b"\"'", b"/\\_=+-@~^`", b"\n"]


def _class_rows() -> np.ndarray:
    rows = [np.zeros(256, bool) for _ in range(4 + len(MARKS))]
    rows[0][65:91], rows[1][97:123], rows[2][48:58], rows[3][128:] = True, True, True, True
    for row, mark in zip(rows[4:], MARKS, strict=True):
        row[list(mark)] = True
    return np.array(rows)


_CLASSES = _class_rows()
FEATURES = len(_CLASSES) + 9 + BUCKETS


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all texts, and the first passage of each text (n + 1 values). A text without words has one, empty."""
    starts, ends, first = word_bounds(data, at)
    count = np.diff(first)
    bags = np.maximum(1, -(-count // PASSAGE))
    cut = np.concatenate([[0], np.cumsum(bags)])
    of = np.repeat(np.arange(len(count)), count)
    where = cut[of] + (np.arange(len(of)) - first[of]) // PASSAGE  # passage of each word
    total = int(cut[-1])
    words = np.bincount(where, minlength=total).astype(float)
    some = np.maximum(words, 1)
    out = np.zeros((total, FEATURES), np.float32)
    chars = np.bincount(where, weights=ends - starts, minlength=total)
    reach = np.append(starts[1:], len(data))  # a word and the white space after it, within its text
    if len(starts):
        reach = np.minimum(reach, at[of + 1])
    for k, row in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(row[data])])
        out[:, k] = np.bincount(where, weights=sums[reach] - sums[starts], minlength=total) / np.maximum(chars, 1)
    k = len(_CLASSES)
    lowered = LOWER[data]
    hashes = word_hashes(lowered, starts, ends)
    upper = np.concatenate([[0], np.cumsum(_CLASSES[0][data])])
    letters = upper + np.concatenate([[0], np.cumsum(_CLASSES[1][data] | _CLASSES[3][data])])
    n_letters = letters[ends] - letters[starts]
    n_upper = upper[ends] - upper[starts]
    in_passage = hashes + salts(where)
    fresh = np.zeros(len(hashes))
    fresh[np.unique(in_passage, return_index=True)[1]] = 1
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    pair_at, pair = window_hashes(hashes + salts(of), first, 2)
    _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
    again = np.zeros(len(hashes))
    again[pair_at] = times[which] > 1
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?,;:", np.uint8)) if len(ends) else np.zeros(0)
    for values in (fresh, same, again, n_letters == 0, (n_upper > 1) & (n_upper == n_letters), data[starts] < 91, stop):
        out[:, k] = np.bincount(where, weights=values, minlength=total) / some
        k += 1
    out[:, k] = np.minimum(chars / some, 30) / 10
    out[:, k + 1] = np.log1p(words) / 5
    k += 2
    mixed = mix(hashes)
    sign = 1 - 2 * (mixed >> np.uint64(63)).astype(np.int64)
    bucket = (mixed & np.uint64(BUCKETS - 1)).astype(np.int64)
    bags_of = np.bincount(where * BUCKETS + bucket, weights=sign, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, k:] = bags_of / np.sqrt(some)[:, None] / 4
    return out, cut


def _segment_sum(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, cut[:-1], axis=0)


class AttentionModel:
    """tanh encoder, gated attention over passages, logistic score of the weighted mean."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.w = {
            "encode": scale(FEATURES, HIDDEN), "bias": np.zeros(HIDDEN), "tanh": scale(HIDDEN, GATE), "gate": scale(HIDDEN, GATE),
            "attend": scale(GATE, 1)[:, 0], "out": scale(HIDDEN, 1)[:, 0], "out_bias": np.zeros(1)}

    def forward(self, x: np.ndarray, cut: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        z = np.tanh(x @ w["encode"] + w["bias"])
        t, g = np.tanh(z @ w["tanh"]), 1 / (1 + np.exp(-(z @ w["gate"])))
        raw = (t * g) @ w["attend"]
        sizes = np.diff(cut)
        weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, cut[:-1]), sizes))
        weight /= np.repeat(_segment_sum(weight, cut), sizes)
        bag = _segment_sum(z * weight[:, None], cut)
        score = 1 / (1 + np.exp(-(bag @ w["out"] + w["out_bias"])))
        return {"x": x, "z": z, "t": t, "g": g, "weight": weight, "bag": bag, "score": score}

    def gradients(self, f: dict[str, np.ndarray], cut: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w, sizes = self.w, np.diff(cut)
        d_score = (f["score"] - label) / len(label)
        d_bag = np.repeat(d_score[:, None] * w["out"], sizes, axis=0)
        d_weight = (d_bag * f["z"]).sum(axis=1)
        d_raw = f["weight"] * (d_weight - np.repeat(_segment_sum(d_weight * f["weight"], cut), sizes))
        d_t = d_raw[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2)
        d_g = d_raw[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
        d_z = d_bag * f["weight"][:, None] + d_t @ w["tanh"].T + d_g @ w["gate"].T
        d_in = d_z * (1 - f["z"] ** 2)
        return {
            "encode": f["x"].T @ d_in, "bias": d_in.sum(axis=0), "tanh": f["z"].T @ d_t, "gate": f["z"].T @ d_g,
            "attend": (f["t"] * f["g"]).T @ d_raw, "out": f["bag"].T @ d_score, "out_bias": np.array([d_score.sum()])}

    def fit(self, x: np.ndarray, cut: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.005, decay: float = 1e-4):
        """Adam on the logistic loss, over texts in a fixed random order; a small sample is gone over more often."""
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(label)))
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(u) for k, u in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for begin in range(0, len(order), batch):
                some = order[begin : begin + batch]
                rows = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in some])
                own = np.concatenate([[0], np.cumsum(cut[some + 1] - cut[some])])
                step += 1
                found = self.gradients(self.forward(x[rows], own), own, label[some])
                slow = rate * (1 - epoch / epochs)
                for k, d in found.items():
                    d = d + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.w[k] = self.w[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return np.round(self.forward(x, cut)["score"], 6)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in passes(batch):
            x, cut = passages(data, at)
            yield pa.RecordBatch.from_arrays([
                rows.column("label"), pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["label", "passages"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel | None:
    """A model fitted on at most `sample` labelled texts (docs: doc_id, text; labels: doc_id, quality 0 or 1), the ones of
    smallest hashed id; rows without text, id or label are not learned from. None without texts of both labels.

    Labels are counted first, so only about the sampled texts are read out of the scan.
    """
    labels = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    count = labels.count()
    key = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    few = labels.filter(key < int(min(1.0, 0.95 * sample / max(count, 1)) * (1 << 30)))
    few = F.broadcast(few.limit(sample))  # at most `sample` rows
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.filter("text is not null").join(few, "doc_id").select("label", "text").limit(2 * sample)
    rows = rows.mapInArrow(_encoded, "label int, passages binary").collect()
    rows = sorted(rows, key=lambda r: (r["label"], r["passages"]))
    if len({r["label"] for r in rows}) < 2:
        return None
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, FEATURES) for r in rows]
    cut = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return AttentionModel().fit(np.concatenate(bags).astype(float), cut, np.array([r["label"] for r in rows], float))


def _scores(model: AttentionModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in passes(batch):
                score = model.score(*passages(data, at)) if model else np.full(rows.num_rows, 0.5)
                yield rows.append_column("score", pa.array(score))
    return run


def score_texts(docs: DataFrame, model: AttentionModel | None, columns: list[str] | None = None) -> DataFrame:
    """`docs` (or its `columns`; `text` is among them) with `score`, the probability of label 1, of every whole text.

    Null, empty and white-space texts are one empty passage, and have its score; every text scores 0.5 without a model. A
    column of `docs` that is called score is replaced.
    """
    docs = docs.select(*[c for c in columns or docs.columns if c != "score"]).withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_scores(model), StructType([*docs.schema.fields, StructField("score", DoubleType())]))
