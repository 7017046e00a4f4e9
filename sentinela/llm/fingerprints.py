"""Document fingerprints of closed syncmers.

A k-mer of code points is chosen when the smallest of its s-mers is its first or last one. Whether a k-mer is chosen depends
on nothing outside it, so equal passages have equal anchors wherever they stand: any 2 K - S - 1 = 15 code points in a row
hold one. Two texts of less than SHORT code points, which may share less, are compared by all their s-mers too, and two of
less than 2 S by their code points. So a text of three code points or more that keeps its first two thirds keeps an anchor,
and one that grows by a code point keeps nearly all. A fingerprint is the hash and position of each distinct anchor; two are
alike as far as common anchors of the kinds that both texts have follow one another in the same order.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.llm.tokens import mix, powers

K = 10
S = 4
SHORT = 3 * K
# The kind of an anchor is in the last bits of its hash; a text has those up to its own kind, and always some of that.
SYNCMER, INNER, POINT = 0, 1, 2
KINDS = np.uint32(3)
PART_BYTES = 8_000_000
MOST_PARTS = 20_000

COMPARED = (
    "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, next_id bigint")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _rolling(points: np.ndarray, size: int) -> np.ndarray:
    n = len(points)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (30 bits, and the kind) and positions of the first occurrence of each anchor, by position, of one position longer ones first.

    Anchors are the chosen k-mers, in a text of less than SHORT code points also all s-mers, and in one of less than 2 S also
    all code points. The empty text has none.
    """
    points = code_points(text)
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]

    def add(places: np.ndarray, values: np.ndarray, kind: int) -> None:
        at.append(places)
        hashes.append((values >> np.uint64(32)).astype(np.uint32) & ~KINDS | np.uint32(kind))

    if len(points) >= K:
        inner = _rolling(points, S)
        width = K - S + 1
        least = _sliding_least(inner, width)
        chosen = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
        add(chosen, _rolling(points, K)[chosen], SYNCMER)
    for size, most, kind in ((S, SHORT, INNER), (1, 2 * S, POINT)):
        if size <= len(points) < most:
            add(np.arange(len(points) - size + 1), _rolling(points, size), kind)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], hashes[order]
    _, firsts = np.unique(hashes, return_index=True)
    firsts.sort()
    return hashes[firsts], at[firsts]


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Hashes, then positions, as base64 of little-endian 32-bit values, with a dot between; '' for no anchor."""
    hashes, at = found
    if len(hashes) == 0:
        return ""
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode() + "." + base64.b64encode(at.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, at = fingerprint.partition(".")
    return np.frombuffer(base64.b64decode(hashes), "<u4"), np.frombuffer(base64.b64decode(at), "<u4").astype(np.int64)


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """2 m / (a + b) for the longest run of m common anchors in the same order, a and b counting the anchors of the kinds that
    both texts have; 1 for two empty fingerprints, 0 for one."""
    if len(one[0]) == 0 or len(two[0]) == 0:
        return float(len(one[0]) == len(two[0]))
    first, second = one[0], two[0]
    common = min((first & KINDS).max(), (second & KINDS).max())
    if common < POINT:
        first, second = first[(first & KINDS) <= common], second[(second & KINDS) <= common]
    _, a, b = np.intersect1d(first, second, assume_unique=True, return_indices=True)
    there = b[np.argsort(a)]  # anchors are held in order
    if np.all(there[1:] > there[:-1]):
        chain = len(there)
    else:
        ends: list[int] = []
        for x in there.tolist():
            k = bisect_left(ends, x)
            ends[k : k + 1] = [x]
        chain = len(ends)
    return 2 * chain / (len(first) + len(second))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part and order: each row but a part's copy of the next part's first meets the row after it."""
    before, out, held = None, [], 0
    for batch in batches:
        for part, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
            if before and before[0] != part:
                before = None
            if tail and before is None:  # a second copy of the row that follows
                continue
            now = (part, doc_id, text or "", anchors(text or ""))
            if before:
                _, i, own, found = before
                size = len(own) // 3
                edited = own[: len(own) - size] + now[2][:size]
                changed = anchors(edited)
                out.append((i, len(own), edited, written(found), written(changed), likeness(found, changed), likeness(found, now[3]), doc_id))
                held += len(own)
            before = None if tail else now
            if held > 4_000_000:
                yield _batch(out)
                out, held = [], 0
    if out:
        yield _batch(out)


NO_ID = -(1 << 63)


def part_of(splits: list[int], within: dict[int, list[int]]) -> Column:
    """The part of a row by doc_id, order and tie: 0 holds the largest ids. Null ids count as smallest.

    `splits` are quantiles of the ids. An id that is several of them has that many parts of its own, by `within`, the quantiles
    of its rows' order; rows of an order that is several of these are dealt by their tie.
    """
    ids, times = np.unique(np.array(splits, np.int64), return_counts=True)
    many = times > 1
    # parts before the first one of ids up to ids[k]: one for larger ids, and those of every greater split
    slots = np.where(many, times + 1, 1)
    before = 1 + slots[::-1].cumsum()[::-1] - slots
    bounds = {i: np.array(sorted(within.get(i, [])), np.int64) for i in ids[many].tolist()}

    @F.pandas_udf("int")
    def number(doc_ids: pd.Series, orders: pd.Series, ties: pd.Series) -> pd.Series:
        own, order, tie = doc_ids.to_numpy(), orders.to_numpy(), ties.to_numpy()
        at = np.searchsorted(ids, own, "left")
        inside = at < len(ids)
        k = np.minimum(at, len(ids) - 1)
        found = np.where(inside, before[k] + np.where(many[k], times[k], 0), 0) if len(ids) else np.zeros(len(own), np.int64)
        for i in np.unique(own[inside & (ids[k] == own) & many[k]]) if len(ids) else ():
            rows, splits = np.flatnonzero(own == i), bounds[int(i)]
            above = len(splits) - np.searchsorted(splits, order[rows], "right")
            equal = np.searchsorted(splits, order[rows], "right") - np.searchsorted(splits, order[rows], "left")
            which = int(np.searchsorted(ids, i))
            found[rows] = before[which] + np.minimum(above + tie[rows] % np.maximum(equal, 1), times[which] - 1)
        return pd.Series(found.astype(np.int32))

    return number(F.coalesce("doc_id", F.lit(NO_ID)), F.col("order"), F.col("tie"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_chars, edited_text, fingerprint,
    edited_fingerprint, near_edited, near_next, next_id.

    The next document is that of the next smaller doc_id, after the last one the first; a single row is its own next. Rows
    of one id follow one another by hash of text, null ids come last. Null texts count as empty; an empty text has an empty
    fingerprint, like only to another empty one. An empty table gives an empty one.

    Rows are dealt to parts by ranges of ids, and rows of an id with a large share, or without id, by ranges of their hash and
    then by row, so text is shuffled once and no part is much larger than another. The first row of each part is also sent to
    the part before; these are one row per part.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_PARTS, 1 + size // PART_BYTES))
    quantiles = lambda c, n: F.percentile_approx(c, [(i + 1) / (n + 1) for i in range(n)], 20_000)
    splits = docs.agg(quantiles(F.coalesce("doc_id", F.lit(NO_ID)), parts)).first()[0] or []
    numbered = docs.select(
        "doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("order"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)).alias("tie"))
    hot = {i: n for i, n in Counter(splits).items() if n > 1}
    # quantiles within ids that have several parts, of which there are half as many as parts at most
    within = {}
    if hot:
        own = F.coalesce("doc_id", F.lit(NO_ID))
        few = numbered.filter(own.isin(list(hot))).groupBy(own.alias("id")).agg(quantiles(F.col("order"), max(hot.values())).alias("q"))
        for r in few.collect():
            step = len(r["q"]) / hot[r["id"]]
            within[r["id"]] = [r["q"][int(k * step)] for k in range(1, hot[r["id"]])]
    rows = numbered.withColumn("part", part_of(splits, within))
    head = F.max(F.struct("doc_id", "order", "tie")).alias("head")
    heads = rows.groupBy("part").agg(head).orderBy("part").collect()  # one row per part
    if not heads:
        return docs.sparkSession.createDataFrame([], COMPARED)
    to = [(h["part"], h["head"]["doc_id"], h["head"]["order"], h["head"]["tie"], heads[k - 1]["part"]) for k, h in enumerate(heads)]
    to = docs.sparkSession.createDataFrame(to, "hp int, hid bigint, horder bigint, htie bigint, to int")
    first = (F.col("part") == F.col("hp")) & F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("order") == F.col("horder")) & (F.col("tie") == F.col("htie"))
    tails = F.when(F.col("to").isNotNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")), F.struct(F.col("to").alias("part"), F.lit(1).alias("tail"))))
    tails = F.coalesce(tails, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))))
    sent = rows.join(F.broadcast(to), first, "left").withColumn("as", F.explode(tails))
    sent = sent.select(F.col("as.part").alias("part"), F.col("as.tail").alias("tail"), "doc_id", "order", "tie", "text")
    sent = sent.repartition(parts, "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), F.desc("order"), F.desc("tie"))
    return sent.select("part", "tail", "doc_id", "text").mapInArrow(_compare, COMPARED)
