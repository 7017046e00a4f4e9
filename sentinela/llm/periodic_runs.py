"""Periodic runs of words, by minimizers at many scales.

A run is a stretch of words with smallest period p, at least TIMES p and LEAST words long, that no neighbouring word
extends. Periods up to SHORT are found by comparing every word with the one p further on. Longer ones are dealt to scales.
At a scale for periods first to last, a window of `window` consecutive n-grams of `size` = last words selects the one of
least hash. Inside a run the windows p apart hold the same words, so both select the same n-gram, and as
`size` >= p - 1 words fix the place within a period, no equal n-gram lies between. So some two neighbours among the equal
minimizers of a text lie exactly p apart: each such pair seeds one extension to both sides. A run of TIMES p words holds
two whole windows p apart because window <= (TIMES - 1) first - size + 1, so no run is missed whatever the hashes are.

A scale selects about 2 / window of all words, and an extended stretch is twice its period long or more, of which a text
can have few; the work is about n log n words for a text of n words, and holds nothing but the arrays of one pass of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import passes
from sentinela.llm.tokens import joined_words, mix, salts, stretch_hashes, word_bounds, word_hashes

LEAST = 24
TIMES = 3
SHORT = 8

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, n_dropped bigint, collapsed_text string"


def scales(n_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, size, window) of every scale that a text of `n_words` words can have a run of."""
    first = SHORT + 1
    while TIMES * first <= n_words:
        last = first + first // 2
        yield first, last, last, (TIMES - 1) * first - last + 1
        first = last + 1


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive keys: of the end of one block and the beginning of the next."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onwards[: n - width + 1], upto[width - 1 : n])


def minimizer_pairs(words: np.ndarray, first: int, last: int, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (first to last) of neighbours among equal minimizers of a sequence."""
    grams = len(words) - size + 1
    if grams < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(grams)
    hashes = stretch_hashes(words, starts, starts + size)
    # the place fills the low bits, so that the least key tells where it is, and the first of equal n-grams is taken
    low = np.uint64((1 << grams.bit_length()) - 1)
    chosen = (window_least((hashes & ~low) | starts.astype(np.uint64), window) & low).astype(np.int64)
    chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])]
    order = np.argsort(hashes[chosen], kind="stable")
    places, values = chosen[order], hashes[chosen][order]
    distance = places[1:] - places[:-1]
    pair = (values[1:] == values[:-1]) & (distance >= first) & (distance <= last)
    return places[:-1][pair], distance[pair]


def _agreeing(words: np.ndarray, place: int, lag: int, step: int) -> int:
    """How many words from `place` on, in direction `step`, equal the word `lag` further on."""
    done, size = 0, 64
    while True:
        if step > 0:
            size = min(size, len(words) - lag - place - done)
            one = words[place + done : place + done + size]
            two = words[place + done + lag : place + done + lag + size]
        else:
            size = min(size, place - done + 1)
            one = words[place - done - size + 1 : place - done + 1][::-1]
            two = words[place - done - size + 1 + lag : place - done + 1 + lag][::-1]
        if size <= 0:
            return done
        unlike = np.flatnonzero(one != two)
        if len(unlike):
            return done + int(unlike[0])
        done, size = done + size, 2 * size


def _seeded(words: np.ndarray, places: np.ndarray, lags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the stretch around each seed; seeds within a stretch of their lag are passed over."""
    found, lag, upto = [], 0, -1
    order = np.lexsort((places, lags))
    for place, distance in zip(places[order].tolist(), lags[order].tolist(), strict=True):
        if distance != lag:
            lag, upto = distance, -1
        if place < upto:
            continue
        before, after = _agreeing(words, place - 1, lag, -1), _agreeing(words, place, lag, 1)
        upto = place + after
        found.append((place - before, before + after + lag, lag))
    return found


def _scanned(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, lag) of every maximal stretch of `least` words or more in which words `lag` apart are equal."""
    if len(words) <= lag:
        return []
    alike = np.concatenate([[False], words[:-lag] == words[lag:], [False]])
    change = np.flatnonzero(alike[1:] != alike[:-1])
    starts, lengths = change[::2], change[1::2] - change[::2] + lag
    enough = lengths >= least
    return [(s, n, lag) for s, n in zip(starts[enough].tolist(), lengths[enough].tolist(), strict=True)]


def find_runs(words: np.ndarray, n_words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period, of texts of `n_words` words laid end to end.

    `words` are values of words that no two texts share, so that nothing repeats from one text into the next.
    """
    found = []
    for lag in range(1, SHORT + 1):
        found += _scanned(words, lag, max(LEAST, TIMES * lag))
    of, at = words, None
    for first, last, size, window in scales(int(n_words.max(initial=0))):
        long_enough = n_words >= TIMES * first
        if not long_enough.all():
            at = np.flatnonzero(np.repeat(long_enough, n_words))
            of = words[at]
        places, lags = minimizer_pairs(of, first, last, size, window)
        if len(places):
            found += _seeded(words, places if at is None else at[places], lags)
    best: dict[tuple[int, int], int] = {}
    for start, length, lag in found:
        # a stretch three times as long as a lag that is not its smallest period has been found with the smallest too
        if length >= max(LEAST, TIMES * lag):
            best[start, length] = min(lag, best.get((start, length), lag))
    return sorted((start, length, lag) for (start, length), lag in best.items())


def _of_texts(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    starts, ends, first = word_bounds(data, at)
    n_words = np.diff(first)
    words = mix(word_hashes(data, starts, ends) + salts(np.repeat(np.arange(len(n_words)), n_words)))
    runs = sorted(find_runs(words, n_words), key=lambda r: (r[0], r[2]))
    start, length, period = (np.array([r[k] for r in runs], np.int64) for k in range(3))
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    gone = np.cumsum(steps)[:-1] > 0
    text, cuts = joined_words(data, at, starts, ends, first, gone)
    bounds = np.searchsorted(start, first)
    listed = pa.StructArray.from_arrays(
        [pa.array(x) for x in (start - first[np.searchsorted(first, start, "right") - 1], length, period)], fields=list(RUN))
    dropped = np.concatenate([[0], np.cumsum(gone)])[first]
    return pa.RecordBatch.from_arrays([
        rows.column("doc_id"), pa.array(n_words.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), listed), pa.array(np.diff(dropped)),
        pa.StringArray.from_buffers(len(n_words), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(text)),
    ], ["doc_id", "n_words", "runs", "n_dropped", "collapsed_text"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in passes(batch):
            yield _of_texts(rows, data, at)


def detect_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, n_dropped, collapsed_text) of every row of `docs` (doc_id, text; other columns are ignored).

    `runs` lists start (word number from 0), length and period in words of every run of the whole text, by start, then
    period. collapsed_text has the words that no run holds after its first period, joined by one space; n_dropped counts the
    others. A null or empty text has no words, no runs and an empty collapsed text. Rows are looked at one by one: repeated
    rows and null ids stay as they are, an empty table gives an empty one. Words are told apart by a 64-bit hash: among the
    n words of a text, some two unlike ones are taken for equal with a chance of about n**2 / 2**65.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_runs, RESULT)
