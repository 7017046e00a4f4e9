"""Substring dedup: passages of `width` words that occur more than once in the corpus are taken out of every text.

Every window of `width` words has a Rabin-Karp hash. Texts are first written as chunks of a few megabytes. Each chunk sends
its distinct window hashes, sorted, to hash ranges; a range counts in how many places each of its hashes starts and answers
every chunk with one bit per hash. The bits meet their chunk again, and repeated windows merge into maximal intervals of
words. A window that occurs a million times is sent once per chunk, so no range grows with a frequent passage, and the
number of ranges grows with the text, so that a range always holds about the same number of hashes.

Hashes have 64 bits: among n windows about n * n / 2**65 are taken for repeated by chance, 0.0005 for 130 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import passes, stored
from sentinela.llm.tokens import window_hashes, word_bounds, word_hashes

WIDTH = 35
CHUNK_BYTES = 4_000_000
RANGE_BYTES = 8_000_000

CHUNK = "chunk bigint, ids array<bigint>, sizes array<int>, texts binary"
PART = "range int, chunk bigint, hashes binary, many binary"
BITS = "chunk bigint, range int, bits binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,end:bigint>>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer, k, ids, sizes, parts, held = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, [], [], [], 0

    def row():
        return pa.RecordBatch.from_arrays([
            pa.array([k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
            pa.array([packer.compress(b"".join(parts))], pa.binary())], ["chunk", "ids", "sizes", "texts"])

    for batch in batches:
        for rows, data, at in passes(batch, most=CHUNK_BYTES // 4):
            ids += rows.column("doc_id").to_pylist()
            sizes += np.diff(at).tolist()
            parts.append(data.tobytes())
            held += len(data)
            if held >= CHUNK_BYTES:
                yield row()
                k, ids, sizes, parts, held = k + 1, [], [], [], 0
    if ids:
        yield row()


def _windows(sizes: list[int], packed: bytes, width: int):
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
    starts, ends, first = word_bounds(data, at)
    where, hashes = window_hashes(word_hashes(data, starts, ends), first, width)
    return data, at, starts, ends, first, where, hashes


def _parts(ranges: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, packed in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "texts")), strict=True):
                hashes, counts = np.unique(_windows(sizes, packed, width)[-1], return_counts=True)
                cuts = _cuts(hashes, ranges)
                rows = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows, pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                        pa.array([hashes[cuts[r] : cuts[r + 1]].tobytes() for r in rows], pa.binary()),
                        pa.array([np.packbits(counts[cuts[r] : cuts[r + 1]] > 1).tobytes() for r in rows], pa.binary())],
                        ["range", "chunk", "hashes", "many"])
    return run


def _cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal ranges of hash values begins in sorted hashes, and the end."""
    bounds = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)
    return np.append(np.searchsorted(hashes, bounds), len(hashes))


def _count(table: pa.Table) -> pa.Table:
    """One range of hashes: for each chunk, which of its hashes start in more than one place."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("many").to_pylist(), parts, strict=True)]
    hashes, repeated = np.concatenate(parts), np.concatenate(many)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    group = np.cumsum(new) - 1
    twice = np.bincount(group) > 1
    twice |= np.bincount(group, weights=repeated[order]) > 0
    repeated[order] = twice[group]
    cuts = np.cumsum([0, *(len(p) for p in parts)])
    return pa.table({
        "chunk": table.column("chunk"), "range": table.column("range"),
        "bits": pa.array([np.packbits(repeated[cuts[i] : cuts[i + 1]]).tobytes() for i in range(len(parts))], pa.binary())},
        schema=pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("bits", pa.binary())]))


def _removal(ranges: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, packed, found in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "texts", "found")), strict=True):
                data, at, starts, ends, first, where, hashes = _windows(sizes, packed, width)
                distinct, which = np.unique(hashes, return_inverse=True)
                cuts, repeated = _cuts(distinct, ranges), np.zeros(len(distinct), bool)
                for one in found or []:
                    a, b = cuts[one["range"]], cuts[one["range"] + 1]
                    repeated[a:b] = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=b - a)
                begin = where[repeated[which]]
                steps = np.zeros(len(starts) + 1, np.int64)
                np.add.at(steps, begin, 1)
                np.add.at(steps, begin + width, -1)
                gone = np.cumsum(steps)[:-1] > 0
                yield from _results(ids, data, at, starts, ends, first, gone)
    return run


def _results(ids, data, at, starts, ends, first, gone) -> Iterator[pa.RecordBatch]:
    """Kept words joined by one space: the bytes of kept words, and one space after each but the last of its text."""
    kept = np.flatnonzero(~gone)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[kept]] += 1
    edges[ends[kept]] -= 1
    take = np.cumsum(edges[:-1], dtype=np.int32) > 0
    cut = np.searchsorted(kept, first)
    last = np.zeros(len(kept), bool)
    last[cut[1:][cut[1:] > cut[:-1]] - 1] = True
    spaces = ends[kept[~last]]
    out = data.copy()
    out[spaces] = 32
    take[spaces] = True
    text = out[take]
    lengths = np.concatenate([[0], np.cumsum(take)])[at]
    change = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)) if len(gone) else np.zeros(1, np.int8)
    for i in range(0, len(ids), 2000):
        j = min(len(ids), i + 2000)
        spans = [_intervals(gone[first[x] : first[x + 1]]) if change.any() else [] for x in range(i, j)]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids[i:j], pa.int64()),
            pa.array(np.diff(first[i : j + 1]), pa.int64()),
            pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            pa.array([text[lengths[x] : lengths[x + 1]].tobytes().decode("utf-8", "replace") for x in range(i, j)], pa.string()),
            pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def _intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    if not gone.any():
        return []
    change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def remove_repeated_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) of every row of `docs` (doc_id, text; other columns are ignored).

    `removed` lists the maximal intervals [start, end) of removed word positions. A null or empty text has no words and an
    empty kept text; texts shorter than `width` words keep all words. Repeated rows count as separate texts, so a passage of
    a repeated row is removed from each. An empty table gives an empty one; null ids stay null.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = stored(docs.mapInArrow(_chunks, CHUNK))
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
    ranges = 1 + size // RANGE_BYTES
    parts = chunks.mapInArrow(_parts(ranges, width), PART)
    bits = parts.repartition(ranges, "range").groupBy("range").applyInArrow(_count, BITS)
    found = bits.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("found"))
    return chunks.join(found, "chunk", "left").mapInArrow(_removal(ranges, width), RESULT)
