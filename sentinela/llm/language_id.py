"""Language identification in two levels: linear support vector machines tell language families apart, then one machine
for each two languages of a family votes.

Texts are described by hashed byte n-grams of their letters. The machines are fitted on a bounded sample of labelled texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import passes

# Families of common language codes. A language outside these is a family of its own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "indic": ["hi", "ur", "bn", "mr", "gu", "pa", "ne"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "mt", "am"],
}
UNKNOWN = "und"
SAMPLE = 1000
DIMENSIONS = 4096
ORDERS = (1, 2, 3, 4)

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), lang)


def ngram_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of hashed n-gram counts, as unit vectors; one row per text. What is not a letter counts as a space."""
    n = len(at) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    if len(data) == 0:
        return out
    letters = _LETTER[data].astype(np.uint32)
    text = np.repeat(np.arange(n), np.diff(at))
    packed = np.zeros(len(letters), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        packed = (packed[: len(letters) - order + 1] << np.uint32(8)) | letters[order - 1 :]
        if len(packed) == 0:
            break
        # an n-gram lies in one text, and holds no two spaces side by side and not only a space
        fits = text[: len(packed)] == text[order - 1 :]
        if order == 1:
            blank = letters == 32
            pairs = blank[:-1] & blank[1:]
            fits = fits & ~blank
        else:
            held = np.concatenate([[0], np.cumsum(pairs)])
            fits = fits & (held[order - 1 :][: len(packed)] == held[: len(packed)])
        if order in ORDERS:
            key = packed[fits] * np.uint32(2654435761) + np.uint32(order * 40503)
            key = ((key ^ (key >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(20)
            out += np.bincount(text[: len(packed)][fits] * DIMENSIONS + key, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def fit_machine(x: np.ndarray, positive: np.ndarray, steps: int = 80, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear support vector machine: squared hinge loss, accelerated gradient steps, both sides
    weighted alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = np.where(positive, 1, -1).astype(x.dtype)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(x.dtype)
    w = last = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        ahead = w + x.dtype.type(k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        last, w = w, ahead - x.dtype.type(0.5) * (x.dtype.type(decay) * ahead - (share * y * slack) @ x)
    return w


class LanguageModel:
    """Machines for families (one against the rest) and for each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        self.langs = sorted(set(langs))
        families = np.array([family_of(a) for a in langs])
        self.families = sorted(set(families))
        self.by_family = np.array([fit_machine(x, families == f) for f in self.families])
        self.pairs, weights = [], []
        for family in self.families:
            of = [a for a in self.langs if family_of(a) == family]
            for a, b in itertools.combinations(of, 2):
                rows = (names == a) | (names == b)
                self.pairs.append((self.langs.index(a), self.langs.index(b)))
                weights.append(fit_machine(x[rows], names[rows] == a))
        self.by_pair = np.array(weights).reshape(len(weights), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score from 0 to 1 for each row: the family's share times the language's share in its family.

        Shares are those of logistic functions of the margins. Votes tie to the larger sum of margins, then to the first name.
        """
        family = x @ self.by_family[:, :-1].T + self.by_family[:, -1]
        family_share = np.exp(4 * (family - family.max(axis=1, keepdims=True)))
        family_share /= family_share.sum(axis=1, keepdims=True)
        best = family.argmax(axis=1)
        margin = x @ self.by_pair[:, :-1].T + self.by_pair[:, -1]
        share = 1 / (1 + np.exp(-4 * margin))
        votes, total = np.zeros((len(x), len(self.langs))), np.zeros((len(x), len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margin[:, k] >= 0
            votes[:, b] += margin[:, k] < 0
            total[:, a] += share[:, k]
            total[:, b] += 1 - share[:, k]
        own = np.array([self.families.index(family_of(a)) for a in self.langs])
        rivals = np.array([max(1, (own == f).sum() - 1) for f in own])
        total = np.where([[(own == f).sum() == 1 for f in own]], 1.0, total / rivals)
        rank = np.where(own[None, :] == best[:, None], votes + total / 2, -1)
        pick = rank.argmax(axis=1)
        rows = np.arange(len(x))
        return [self.langs[k] for k in pick], np.clip(family_share[rows, best] * total[rows, pick], 0, 1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in passes(batch):
            x = ngram_features(data, at).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """A model of `docs` (doc_id, text, lang), fitted on about `sample` texts of each language, at most 2 * sample.

    Rows without text or language are not learned from. Languages are counted first; a text is drawn by its hashed id and
    content, so a row that is repeated often may be left out. None for a table without languages.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    rows = rows.filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30))
    most = F.create_map(*itertools.chain.from_iterable((F.lit(a), F.lit(int(min(1.0, sample / c) * (1 << 30)))) for a, c in counts.items()))
    drawn = rows.filter(draw < most[F.col("lang")]).select("lang", "text").limit(2 * sample * len(counts))
    found = sorted((r["lang"], r["x"]) for r in drawn.mapInArrow(_featured, "lang string, x binary").collect())
    if not found:
        return None
    x = np.frombuffer(b"".join(b for _, b in found), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    return LanguageModel(x, [a for a, _ in found])


def _has_letter(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> list[bool]:
    ascii_letter = np.diff(np.concatenate([[0], np.cumsum((_LETTER[data] >= 97) & (_LETTER[data] < 128))])[at]) > 0
    other = np.diff(np.concatenate([[0], np.cumsum(data >= 128)])[at]) > 0
    found = ascii_letter.tolist()
    for k in np.flatnonzero(~ascii_letter & other):
        found[k] = any(c.isalpha() for c in rows.column("text")[int(k)].as_py())
    return found


def _predictions(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in passes(batch):
                langs, scores = model.predict(ngram_features(data, at)) if model else ([UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows))
                known = _has_letter(rows, data, at)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array([a if k else UNKNOWN for a, k in zip(langs, known, strict=True)], pa.string()),
                    pa.array(np.where(known, np.round(scores, 6), 0.0))], ["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of `docs` (doc_id, text; other columns are ignored).

    Null texts and texts without a letter are `und` with score 0, and so is every text without a model. Repeated rows are
    predicted each, null ids stay null, an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predictions(model), "doc_id bigint, lang_pred string, score double")


def held_out(crc: Column, folds: int = 5) -> Column:
    return F.pmod(crc, F.lit(folds)) == 0
