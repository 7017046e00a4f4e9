"""Quality rules by weak supervision: each rule votes good or bad or abstains, and the votes are weighed by how far the
rules can be trusted, which expectation-maximisation estimates from their agreement alone.

Texts matter only through their vote pattern, so the estimate runs on counts of patterns: at most 3 ** RULES rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import passes, stored
from sentinela.llm.tokens import SPACE, salts, stretch_hashes, window_hashes, word_bounds, word_hashes

RUN = 3
# Votes, bad and good, that each rule starts from on bad and on good texts.
FIRST_VOTES = ((1.0, 1.0), (2.0, 200.0))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[[ord(c) for c in ".!?"]] = 4

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_letter_words", "n_stops"]


def _counts(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])


def text_statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """One value per text for each of STATISTICS."""
    n = len(at) - 1
    starts, ends, first = word_bounds(data, at)
    kind = _CLASS[data]
    words = word_hashes(data, starts, ends)
    in_text = words + salts(np.repeat(np.arange(n), np.diff(first)))
    where, windows = window_hashes(in_text, first, RUN)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    begin = where[times[which] > 1]
    np.add.at(steps, begin, 1)
    np.add.at(steps, begin + RUN, -1)
    letters = np.concatenate([[0], np.cumsum((kind == 2) | (kind == 3) | (data >= 128))])
    # lines: stretches between \n, with a word
    cut = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([at[:-1], cut + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_of = np.searchsorted(at, line_starts, "right") - 1
    line_ends = np.minimum(np.append(cut, len(data))[np.searchsorted(cut, line_starts)], at[line_of + 1])
    some = np.concatenate([[0], np.cumsum(~SPACE[data])])
    worded = some[line_ends] > some[line_starts]
    line_starts, line_ends, line_of = line_starts[worded], line_ends[worded], line_of[worded]
    lines = stretch_hashes(data, line_starts, line_ends) + salts(line_of)
    _, firsts = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_of, minlength=n)
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    return {
        "n_words": np.diff(first),
        "word_chars": _counts(~SPACE[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": _counts(kind == 1, at),
        "n_dup_lines": n_lines - np.bincount(line_of[firsts], minlength=n),
        "n_repeat_words": _counts(np.cumsum(steps)[:-1] > 0, first),
        "n_lines": n_lines,
        "n_upper": _counts(kind == 2, at),
        "n_lower": _counts(kind == 3, at),
        "n_letter_words": _counts(letters[ends] > letters[starts], first),
        "n_stops": _counts(last == 4, first),
    }


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in passes(batch):
            found = text_statistics(data, at)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(found[s].astype(np.int64)) for s in STATISTICS)], ["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row of `docs` (doc_id, text). Null and empty texts count as having no words."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_statistics, "doc_id bigint, " + ", ".join(f"{s} bigint" for s in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over STATISTICS: 1 good, -1 bad, 0 no opinion. Shares of nothing are null, which is no opinion.

    Some object to much that is good, such as short texts and single lines; how far an objection counts is not set here.
    Symbols are looked at twice, by word and by character.
    """
    share = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    case = F.col("n_upper") / F.when(F.col("n_upper") + F.col("n_lower") > 0, F.col("n_upper") + F.col("n_lower"))
    length = share("word_chars", "n_words")
    stops = share("n_stops", "n_words")
    return {
        "words": _vote(F.col("n_words") >= 100, F.col("n_words") < 80),
        "repeats": _vote(share("n_repeat_words", "n_words") <= 0.1, share("n_repeat_words", "n_words") > 0.3),
        "lines": _vote((F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0), (share("n_dup_lines", "n_lines") > 0.3) | (F.col("n_lines") == 1)),
        "symbols": _vote(share("n_symbols", "n_words") <= 0.02, share("n_symbols", "n_words") > 0.2),
        "sparse": _vote(share("n_symbols", "word_chars") <= 0.005, share("n_symbols", "word_chars") > 0.03),
        "word_length": _vote(length.between(3, 9), (length < 2) | (length > 15)),
        "case": _vote(case <= 0.15, case > 0.4),
        "letters": _vote(share("n_letter_words", "n_words") >= 0.95, share("n_letter_words", "n_words") < 0.85),
        "stops": _vote(stops.between(0.01, 0.34), (stops > 0.5) | (stops < 0.02)),
    }


def estimate(patterns: dict[tuple[int, ...], int], steps: int = 100) -> tuple[float, np.ndarray]:
    """Share of good texts, and how often a vote of each rule is bad and good on bad and on good texts: rates[good, rule, vote > 0].

    Expectation-maximisation over counted vote patterns; rules are taken to vote independently of one another given a text's
    quality, and an abstention says nothing. At first texts with two bad votes or more are taken for bad, those with one for undecided, the others for good.
    Each rate starts from FIRST_VOTES, so that none is 0: a rule is thought to reject a good text in a hundred, as firmly as two
    hundred votes say it, until there are more. A kind of junk is found if more than one rule objects to it: what a single
    rule objects to, and no other, may as well be that rule's error.
    """
    if not patterns:
        return 0.5, np.full((2, 0, 2), 1 / 2)
    seen = np.array(list(patterns))
    counts = np.array(list(patterns.values()), float)
    is_vote = np.array([seen == v for v in (-1, 1)], float)
    bad_votes = (seen < 0).sum(axis=1)
    good = np.where(bad_votes == 0, 1.0, np.where(bad_votes == 1, 0.5, 0.0))
    for _ in range(steps):
        prior = float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99))
        rates = np.empty((2, seen.shape[1], 2))
        for k, share in enumerate((1 - good, good)):
            voted = np.einsum("p,vpr->rv", counts * share, is_vote) + FIRST_VOTES[k]
            rates[k] = voted / voted.sum(axis=1, keepdims=True)
        logit = math.log(prior / (1 - prior)) + np.einsum("vpr,rv->p", is_vote, np.log(rates[1] / rates[0]))
        good = 1 / (1 + np.exp(-logit))
    return prior, rates


def accuracies(prior: float, rates: np.ndarray) -> list[float]:
    """How often each rule is right when it votes."""
    return (prior * rates[1, :, 1] + (1 - prior) * rates[0, :, 0]).tolist()


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, STATISTICS, base_failed, the votes as vote_<rule>, quality (posterior probability of being good), kept.

    kept is false where base_failed, else quality >= threshold. Rules without an opinion leave the share of good texts as
    quality. Null and empty texts have no words and fail. Repeated rows are judged, and counted, each; null ids stay null;
    an empty table gives an empty one. Columns of `docs` other than doc_id and text are ignored.
    """
    found = stored(statistics(docs))
    rules = votes()
    voted = found.select("*", *(v.cast("int").alias(f"vote_{r}") for r, v in rules.items()))
    names = [f"vote_{r}" for r in rules]
    counted = voted.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    prior, rates = estimate({tuple(row[n] for n in names): row["count"] for row in counted})
    logit = F.lit(math.log(prior / (1 - prior)))
    for name, (bad, good) in zip(names, np.log(rates[1] / rates[0]).tolist(), strict=False):
        logit = logit + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, good).otherwise(0.0)
    judged = voted.withColumn("quality", F.round(1 / (1 + F.exp(-logit)), 9)).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
