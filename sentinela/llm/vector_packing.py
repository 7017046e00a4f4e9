"""Vector best-fit packing of texts into sequences with several capacities: tokens, documents and attention cost.

A piece of n tokens takes (n, 1, n * n) of a sequence's capacities, so pieces of one length are alike, and a packing is known
by how many pieces there are of each length. Best fit runs over these counts, longest first: among the kinds of open
sequences in which a piece fits under every capacity, it goes to the kind with the least weighted norm of what would be left
(or the least weighted dot product of the piece and what is left, which is the tightest where the piece weighs most), and
fills it with pieces of its length as far as they fit. Sequences of one content are one kind with a count, so the plan has a
few kinds per length, whatever the number of texts.

The first pass tokenises, writes the ids, and numbers the pieces of each length within its task. Running sums over the
tasks' counts make these numbers global, and the plan says for a length and a number which sequence and offset it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm.common import stored

LENGTH = 1024
END_ID = 2
WEIGHTS = (1.0, 0.05, 0.05)
HELD = 900_000

TOKENS = "part bigint, doc_id bigint, doc_tokens bigint, tail bigint, tail_number bigint, full_number bigint, ids binary"
PIECE = (
    "doc_id bigint, piece int, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_tokens bigint, sequence_documents bigint, sequence_attention bigint")

# The tokenizer's cut of a text, for ASCII, and for texts of plain Latin letters and common signs; others go through the whole tokenizer.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(r"[^\x20-\x7e\x09-\x0dÀ-ÖØ-öø-ÿ“”‘’–—…«»¡¿€]")


def _cutter(letters: str, flags: int = 0) -> re.Pattern:
    return re.compile(rf" ?[{letters}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{letters}0-9]+|\s+(?!\S)|\s+", flags)


_CUT_ASCII, _CUT_LATIN = _cutter("A-Za-z", re.ASCII), _cutter(_LATIN)


@cache
def byte_encoder(path: str):
    """A function from texts to their ids as little-endian unsigned 32-bit values, for a byte-level BPE tokenizer file that
    cuts texts into contractions, and runs of letters, of digits, of other signs and of white space. The ids of a cut piece are
    held, up to HELD pieces, and over the tasks of a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    one_piece = Tokenizer(tokenizer.model)
    one_piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    special = [str(t.content) for t in tokenizer.get_added_tokens_decoder().values()]

    held: dict[str, bytes] = {}

    def cut(text: str) -> list[str] | None:
        if any(s in text for s in special):
            return None
        return _CUT_ASCII.findall(text) if text.isascii() else None if _OTHER.search(text) else _CUT_LATIN.findall(text)

    def encode(texts: list[str]) -> list[bytes]:
        parts = [cut(t) for t in texts]
        if len(held) > HELD:
            held.clear()
        new = list(set().union(*(w for w in parts if w)).difference(held))
        for begin in range(0, len(new), 20_000):
            some = new[begin : begin + 20_000]
            ids = (np.array(e.ids, "<u4").tobytes() for e in one_piece.encode_batch_fast(some, add_special_tokens=False))
            held.update(zip(some, ids, strict=True))
        whole = iter(tokenizer.encode_batch_fast([t for t, w in zip(texts, parts, strict=True) if w is None], add_special_tokens=False))
        return [np.array(next(whole).ids, "<u4").tobytes() if w is None else b"".join(map(held.__getitem__, w)) for w in parts]

    return encode


@dataclass
class Plan:
    """Slots by length: the pieces of a length numbered `numbers[k]` on are `copies[k]` in each of the sequences from `sequences[k]` on."""

    slots: dict[int, dict[str, np.ndarray]]
    kinds: list[tuple[int, list[tuple[int, int]]]]

    def place(self, length: int, number: np.ndarray) -> dict[str, np.ndarray]:
        """sequence_id, offset and the sequence's totals for pieces of one length by their numbers."""
        s = self.slots[length]
        k = np.searchsorted(s["numbers"], number, "right") - 1
        within = number - s["numbers"][k]
        found = {"sequence_id": s["sequences"][k] + within // s["copies"][k], "offset": s["offsets"][k] + within % s["copies"][k] * length}
        return found | {name: s[name][k] for name in ("sequence_tokens", "sequence_documents", "sequence_attention")}


def best_fit(counts: dict[int, int], capacities: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> Plan:
    """Pack counts[n] pieces of each length n; see the head of this module. `rule` is norm or dot."""
    whole, weight = np.array(capacities, np.int64), np.array(weights)
    if rule not in ("norm", "dot"):
        raise ValueError(f"no rule {rule}")
    left = np.zeros((0, 3), np.int64)
    many: list[int] = []
    content: list[list[tuple[int, int]]] = []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        need, rest = np.array([length, 1, length * length], np.int64), counts[length]
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens does not fit in an empty sequence")
        while rest:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                share = left[fits] / whole
                score = (weight * (share - need / whole) ** 2).sum(axis=1) if rule == "norm" else (weight * share * (need / whole)).sum(axis=1)
                kind = int(fits[np.argmin(score)])
                room, free, held = left[kind], many[kind], content[kind]
            else:
                kind, room, free, held = -1, whole, rest, []
            copies = int((room // need).min())
            bins = min(free, rest // copies)
            if bins == 0:
                bins, copies = 1, rest
            rest -= bins * copies
            now, after = [*held, (length, copies)], room - need * copies
            if kind >= 0 and bins == free:
                left[kind], content[kind] = after, now
                continue
            if kind >= 0:
                many[kind] -= bins
            left, many = np.vstack([left, after]), [*many, bins]
            content.append(now)
    return _plan(list(zip(many, content, strict=True)))


def _plan(kinds: list[tuple[int, list[tuple[int, int]]]]) -> Plan:
    rows: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bins, content in kinds:
        totals = (sum(n * c for n, c in content), sum(c for _, c in content), sum(n * n * c for n, c in content))
        offset = 0
        for length, copies in content:
            rows.setdefault(length, []).append((used.get(length, 0), sequence, copies, offset, *totals))
            used[length] = used.get(length, 0) + bins * copies
            offset += length * copies
        sequence += bins
    names = ["numbers", "sequences", "copies", "offsets", "sequence_tokens", "sequence_documents", "sequence_attention"]
    return Plan({n: dict(zip(names, np.array(r, np.int64).T, strict=True)) for n, r in rows.items()}, kinds)


def _tokens(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = byte_encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen, full = np.zeros(length + 1, np.int64), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                ids = [x + end for x in encode([t or "" for t in rows.column("text").to_pylist()])]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                tails = (sizes - 1) % length + 1
                order = np.argsort(tails, kind="stable")
                first = np.flatnonzero(np.append(True, tails[order][1:] != tails[order][:-1]))
                numbers = np.empty(len(ids), np.int64)
                numbers[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
                numbers += seen[tails]
                np.add.at(seen, tails, 1)
                fulls = (sizes - tails) // length
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), part, np.int64)), rows.column("doc_id"), pa.array(sizes), pa.array(tails), pa.array(numbers),
                    pa.array(full + np.cumsum(fulls) - fulls), pa.array(ids, pa.binary()),
                ], ["part", "doc_id", "doc_tokens", "tail", "tail_number", "full_number", "ids"])
                full += int(fulls.sum())
    return run


PLACED = ("sequence_id", "offset", "sequence_tokens", "sequence_documents", "sequence_attention")


def _cut(plan: Plan, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                yield _pieces(batch.slice(begin, 500), plan, length)
    return run


def _pieces(rows: pa.RecordBatch, plan: Plan, length: int) -> pa.RecordBatch:
    sizes, tails, tail_numbers, full_numbers = (rows.column(c).to_numpy() for c in ("doc_tokens", "tail", "tail_number", "full_number"))
    pieces = (sizes - tails) // length + 1
    of = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lengths = np.where(piece == 0, tails[of], length)
    starts = np.where(piece == 0, 0, tails[of] + (piece - 1) * length)
    # full pieces have the last numbers of their length, after the tails that are as long
    numbers = np.where(piece == 0, tail_numbers[of], full_numbers[of] + piece - 1)
    placed = {name: np.zeros(len(of), np.int64) for name in PLACED}
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        for name, values in plan.place(int(n), numbers[which]).items():
            placed[name][which] = values
    ids = rows.column("ids").to_pylist()
    cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(of.tolist(), starts.tolist(), lengths.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([
        rows.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(starts), pa.array(lengths), pa.array(cut, pa.binary()),
        pa.array(sizes[of]), *(pa.array(placed[name]) for name in PLACED),
    ], ["doc_id", "piece", "start", "length", "ids", "doc_tokens", *PLACED])


def pack_best_fit(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", end_id: int = END_ID,
) -> DataFrame:
    """One row per piece of every row of `docs` (doc_id, text; other columns are ignored): doc_id, piece, start, length, ids,
    doc_tokens, sequence_id, offset, and the tokens, documents (pieces) and attention cost of its sequence.

    `ids` are little-endian unsigned 32-bit ids. A text's ids end with `end_id`; null and empty texts are that id alone. A
    text of more than `length` ids is cut into pieces of `length` after a first one that may be shorter. A sequence holds
    `length` tokens, `documents` pieces and `attention` as sum of squared lengths at most; without the last two, what `length`
    allows. Repeated rows are packed again, null ids stay null, an empty table gives an empty one. Raises ValueError where
    a piece does not fit in an empty sequence.

    To the driver come the counts of pieces by length, `length` rows at most.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stored(docs.mapInArrow(_tokens(tokenizer_path, end_id, length), TOKENS))
    whole = F.lit(length).cast("bigint")
    each = F.array(
        F.struct(F.col("tail").alias("size"), F.lit(0).alias("full"), F.lit(1).cast("bigint").alias("n")),
        F.struct(whole.alias("size"), F.lit(1).alias("full"), F.expr(f"(doc_tokens - tail) div {length}").alias("n")))
    counted = stored(tokens.select("part", F.inline(each)).groupBy("part", "size", "full").agg(F.sum("n").alias("n")).filter("n > 0"))
    counts = {r["size"]: r["n"] for r in counted.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, (length, documents or length, attention or length * length), weights, rule)
    # one row per task and length; the pieces of a length are numbered task by task, whole texts' tails before full pieces
    before = F.sum("n").over(Window.partitionBy("size").orderBy("full", "part").rowsBetween(Window.unboundedPreceding, -1))
    numbered = counted.select("part", "size", "full", F.coalesce(before, F.lit(0)).alias("before"))
    tails = numbered.filter("full = 0").select("part", F.col("size").alias("tail"), F.col("before").alias("tails_before"))
    fulls = numbered.filter("full = 1").select("part", F.col("before").alias("fulls_before"))
    placed = tokens.join(tails, ["part", "tail"]).join(fulls, "part", "left").select(
        "doc_id", "doc_tokens", "tail", (F.col("tail_number") + F.col("tails_before")).alias("tail_number"),
        (F.col("full_number") + F.coalesce("fulls_before", F.lit(0))).alias("full_number"), "ids")
    return placed.mapInArrow(_cut(plan, length), PIECE)
