"""Packing: texts are concatenated as token ids and cut every `length` tokens.

The first pass tokenises. Each task numbers the tokens of its texts from 0 and writes ids and first numbers. Its total is
one row; a running sum over these totals, one row per task, gives every task its global offset. The second pass reads the
ids again, adds the offset, and cuts at multiples of `length`: one boundary record per piece. Only the last sequence can be
short, so padding is less than one sequence in all. The ids are written once and never shuffled.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm.common import passes, stored

LENGTH = 4096
END_ID = 2
HELD = 300_000
# Bytes of text, or of ids, that are worked on at once; a longer text is a step of its own.
STEP_BYTES = 1_000_000

TOKENS = "part bigint, doc_id bigint, at bigint, doc_tokens bigint, ids binary"
PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0Da-z0-9ß-öø-ÿ]+")
# Beyond these characters, or with an apostrophe, pieces are not told by _PIECE.
_OTHER = re.compile(r"[^\x20-\x26\x28-\x7e\x09-\x0dÀ-ÖØ-öø-ÿ]")


@cache
def text_encoder(path: str):
    """A function from texts to their ids as little-endian unsigned 32-bit values, for the tokenizer file at `path`.

    For a tokenizer that lower-cases, drops white space, and cuts texts into runs of letters, single digits and runs of
    other signs, with tokens that mark the end of a piece. Pieces of texts in plain Latin letters are taken by one pattern,
    and their ids are held, up to HELD pieces and over the tasks of a worker: the tokenizer's model seldom sees a piece again.
    Words of other texts go through the whole tokenizer.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    pieces_only = Tokenizer(tokenizer.model)
    pieces_only.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    held_pieces: dict[str, bytes] = {}
    held_words: dict[str, bytes] = {}

    def learn_pieces(new: list[str]) -> None:
        ids = np.array(pieces_only.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.concatenate([[0], np.flatnonzero(ends[ids]) + 1])
        if len(cuts) != len(new) + 1:
            raise ValueError("the tokenizer does not mark the end of each piece")
        packed = ids.tobytes()
        held_pieces.update((w, packed[4 * x : 4 * y]) for w, x, y in zip(new, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def learn_words(new: list[str]) -> None:
        found = tokenizer.encode("\n".join(new), add_special_tokens=False)
        of, values = np.array([x for x, _ in found.offsets], np.int64), np.array(found.ids, "<u4")
        cuts = np.searchsorted(of, np.cumsum([0, *(len(w) + 1 for w in new)]))
        held_words.update((w, values[cuts[k] : cuts[k + 1]].tobytes()) for k, w in enumerate(new))

    def encode(texts: list[str]) -> list[bytes]:
        plain = [not _OTHER.search(t) and "<|" not in t for t in texts]
        parts = [_PIECE.findall(t.lower()) if p else _WORD.findall(t) for t, p in zip(texts, plain, strict=True)]
        for held, learn, kind in ((held_pieces, learn_pieces, True), (held_words, learn_words, False)):
            if len(held) > HELD:
                held.clear()
            if new := list(set().union(*(w for w, p in zip(parts, plain, strict=True) if p is kind)).difference(held)):
                learn(new)
        return [b"".join(map((held_pieces if p else held_words).__getitem__, w)) for w, p in zip(parts, plain, strict=True)]

    return encode


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, at = text_encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, _, _ in passes(batch, "text", STEP_BYTES):
                ids = [x + end for x in encode([t or "" for t in rows.column("text").to_pylist()])]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                firsts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), part, np.int64)), rows.column("doc_id"), pa.array(firsts), pa.array(sizes),
                    pa.array(ids, pa.binary())], ["part", "doc_id", "at", "doc_tokens", "ids"])
    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in passes(batch, "ids", STEP_BYTES):
                yield _pieces(rows, length)
    return run


def _pieces(rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    out: list[tuple] = []
    for doc_id, at, count, ids in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "at", "doc_tokens", "ids")), strict=True):
        start = 0
        while start < count:
            sequence, offset = divmod(at + start, length)
            size = min(length - offset, count - start)
            out.append((doc_id, start, size, ids[4 * start : 4 * (start + size)], count, sequence, offset))
            start += size
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every row of `docs` (doc_id, text; other columns are ignored): doc_id, start, length, ids, doc_tokens,
    sequence_id, offset, sequence_tokens, padded_length.

    `ids` are little-endian unsigned 32-bit ids. A text's ids end with `end_id`; null and empty texts are that id alone.
    Sequences are gapless from 0, and every id lies in exactly one piece. sequence_tokens is the number of ids in a sequence,
    padded_length is `length`, or sequence_tokens where that is a power of two. Repeated rows are packed again, null ids
    stay null, a text may span any number of sequences, an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stored(docs.mapInArrow(_tokens(tokenizer_path, end_id), TOKENS))
    # one row per task of the first pass, as in a list of its files
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = stored(totals.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")))
    total = totals.agg(F.max("total")).first()[0] or 0
    placed = tokens.join(F.broadcast(totals.select("part", "before")), "part")
    pieces = placed.select("doc_id", (F.col("at") + F.col("before")).alias("at"), "doc_tokens", "ids")
    cut = pieces.mapInArrow(_cut(length), PIECE)
    fill = F.least(F.lit(length).cast("bigint"), F.lit(total) - F.col("sequence_id") * length)
    power = (fill > 0) & (fill.bitwiseAND(fill - 1) == 0)
    return cut.select(
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", fill.alias("sequence_tokens"),
        F.when(power, fill).otherwise(F.lit(length)).cast("bigint").alias("padded_length"))

