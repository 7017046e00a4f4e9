"""Repair of turn structure: the cheapest edits that make roles read `(s?(ua)+)?`, as a lightest derivation.

An item says that the first rows of a conversation are dealt with and which role the repaired conversation ends with so
far. Its value is (cost, audit), the audit being the initials of the edits. A deduction takes the item before and a row, a
fact of value (0, ""), or the item alone for an insertion, adds the edit's cost and its initial, and gives the next item.
Both only grow, so the function is superior, and it keeps the order of values; the agenda therefore pops items as Knuth's
generalisation of shortest paths does, each first with its lightest value, and stops when the goal item is final.

Rows are dealt to tasks by ranges of (conversation, turn) and cut into pieces of PIECE_ROWS. A conversation that one task
sees whole, in one piece, has one goal. A piece of a longer one is solved from each role its beginning can follow to each
it can end with. Such span items are the facts of a second agenda over pieces, which holds no texts and no long audits: an
item points at the one before. No item just after a row has an audit that begins another such item's, because each has one
initial per row, the last of them in the end; so which of two audits is less is settled where they part, and one answer for
each two items of a layer is all that the layer after it needs. Results do not depend on where pieces are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela.llm.common import stored

PIECE_ROWS = 64
PIECE_BYTES = 1_000_000
SPACES = " \t\n\x0b\x0c\r"

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, END = "", "end"
STATES = (START, "s", "u", "a")
NAMES = {"u": "user", "a": "assistant"}
# initials that may follow each state
NEXT = {START: "su", "s": "u", "u": "a", "a": "u"}

Row = tuple[str, bool, bool]  # initial of the role, must be deleted, is truncated
Value = tuple[int, str]


def deductions(rows: Sequence[Row], place: int, state: str, inserted: bool) -> Iterator[tuple[tuple[int, str, bool], int, str]]:
    """Items that follow from one item, with the cost and the initial that each adds."""
    turn = "a" if state == "u" else "u"
    if place == len(rows):
        if state in (START, "a"):
            yield (place, END, False), 0, ""
    else:
        initial, gone, truncated = rows[place]
        more = TRUNCATED if truncated else 0
        yield (place + 1, state, False), DELETE, "D"
        if not gone:
            if initial and initial in NEXT[state]:
                yield (place + 1, initial, False), more, "K"
            yield (place + 1, turn, False), REROLE + more, "R"
    yield (place, turn, True), INSERT, "I"


def lightest(rows: Sequence[Row], enter: str, goals: Iterable[str]) -> dict[str, Value]:
    """Values of the `goals` (states just after the last row, or END), from the state `enter`; those that none reaches are left out."""
    wanted, found, final = set(goals), {}, set()
    agenda: list[tuple[int, str, tuple[int, str, bool]]] = [(0, "", (0, enter, False))]
    while agenda and wanted:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final.add(item)
        place, state, inserted = item
        if place == len(rows) and not inserted and state in wanted:
            wanted.discard(state)
            found[state] = (cost, audit)
        if state != END:
            for consequent, more, initial in deductions(rows, *item):
                if consequent not in final:
                    heappush(agenda, (cost + more, audit + initial, consequent))
    return found


def joined(pieces: Sequence[dict[tuple[str, str], Value]]) -> tuple[int, list[tuple[str, str]]]:
    """Cost of the lightest way through span items (enter, leave) of consecutive pieces, and (enter, audit) in each piece."""
    agenda: list[tuple[int, int, str]] = [(0, 0, START)]
    ways: dict[tuple[int, str], list[tuple[int, str, str]]] = {}
    final: dict[tuple[int, str], tuple[str, str]] = {(0, START): ("", "")}
    less: dict[tuple[int, str, str], int] = {}

    def order(place: int, one: tuple[str, str], two: tuple[str, str]) -> int:
        """-1, 0 or 1 as the audit of `one` (state before the last piece, audit in it) is less, equal or greater."""
        before = 0 if one[0] == two[0] else less[place - 1, one[0], two[0]]
        return before or (one[1] > two[1]) - (one[1] < two[1])

    while agenda:
        cost, place, state = heappop(agenda)
        if place:
            if (place, state) in final:
                continue
            best = None
            for c, *way in ways.pop((place, state)):
                if c == cost and (best is None or order(place, tuple(way), best) < 0):
                    best = tuple(way)
            for other in STATES:
                if (place, other) in final:
                    sign = order(place, best, final[place, other])
                    less[place, state, other], less[place, other, state] = sign, -sign
            final[place, state] = best
        if state == END:
            taken, at = [], state
            for k in range(place, 0, -1):
                before, audit = final[k, at]
                taken.append((before, audit))
                at = before
            return cost, taken[::-1]
        goals = (END,) if place + 1 == len(pieces) else STATES
        for leave in goals:
            if (span := pieces[place].get((state, leave))) and (place + 1, leave) not in final:
                ways.setdefault((place + 1, leave), []).append((cost + span[0], state, span[1]))
                heappush(agenda, (cost + span[0], place + 1, leave))
    raise ValueError("deleting every row is always possible")


def replay(enter: str, audit: str, roles: Sequence[str], texts: Sequence[str]) -> tuple[str, list[tuple[str, str, str]]]:
    """The state after a piece, and (role, text, edit) of the turns that its edits leave."""
    state, place, out = enter, 0, []
    for edit in audit:
        turn = "a" if state == "u" else "u"
        if edit == "I":
            out.append((NAMES[turn], "", edit))
            state = turn
            continue
        role, text = roles[place], texts[place]
        place += 1
        if edit == "K":
            out.append((role, text, edit))
            state = role[0]
        elif edit == "R":
            out.append((NAMES[turn], text, edit))
            state = turn
    return state, out


SPAN = pa.struct([("enter", pa.string()), ("leave", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns"]
PIECE = (
    "part int, piece bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", first string, last string, least bigint, most bigint, "
    "spans array<struct<enter: string, leave: string, cost: bigint, audit: string>>, roles array<string>, texts array<string>")
LEGAL = {"su", "ua", "au"}


def _piece(rows: list[dict], enters: Sequence[str], leaves: Sequence[str]) -> dict:
    """One piece as a record, solved from each of `enters` to each of `leaves`."""
    faults = ["blank" if r["blank"] else "duplicate" if r["again"] else "truncated" if r["cut"] else "" for r in rows]
    initials = [r["role"][:1] for r in rows]
    codes = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    solved = {enter: lightest(codes, enter, leaves) for enter in enters}
    return {
        "n_rows": len(rows), "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "distinct_turns": len(set(turns)),
        "first": initials[0], "last": initials[-1], "least": min(turns, default=None), "most": max(turns, default=None),
        "spans": [{"enter": e, "leave": to, "cost": c, "audit": a} for e, found in solved.items() for to, (c, a) in found.items()],
        "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows]}


def _pieces(schema: pa.Schema, piece_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[dict] = []
        size = 0
        enters: Sequence[str] = STATES  # what the first conversation of a task has before it is not known here

        def close(leaves: Sequence[str]) -> Iterator[dict]:
            nonlocal count, held, size
            if held:
                yield {"conv_id": held[0]["conv_id"], "part": part, "piece": count, **_piece(held, enters, leaves)}
                count, held, size = count + 1, [], 0

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and r["conv_id"] != held[0]["conv_id"]:
                    out += close((END,))
                    enters = (START,)
                elif len(held) >= piece_rows or size > PIECE_BYTES:
                    out += close(STATES)
                    enters = STATES
                held.append(r)
                size += len(r["text"])
            yield pa.RecordBatch.from_pylist(out, schema)
        # nor what the last one has after it
        yield pa.RecordBatch.from_pylist(list(close((*STATES, END))), schema)
    return run


def _solve(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_solved(r["conv_id"], r["pieces"]) for r in batch.to_pylist()], schema)
    return run


def _solved(conv_id, pieces: list[dict]) -> dict:
    pieces.sort(key=lambda p: (p["part"], p["piece"]))
    cost, taken = joined([{(s["enter"], s["leave"]): (s["cost"], s["audit"]) for s in p["spans"]} for p in pieces])
    total = {c: sum(p[c] for p in pieces) for c in COUNTS}
    least = most = None
    for p in pieces:
        total["distinct_turns"] -= most is not None and p["least"] == most
        least = p["least"] if least is None else least
        most = p["most"] if p["most"] is not None else most
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(pieces, pieces[1:], strict=False))
    gaps = 0 if least is None else most - least + 1 - total["distinct_turns"]
    return {
        "conv_id": conv_id, "gaps": min(gaps, 2**63 - 1), **{c: total[c] for c in ("n_rows", "blank", "duplicate", "truncated", "illegal")},
        "cost": cost, "audit": "".join(a for _, a in taken),
        "taken": [{"part": p["part"], "piece": p["piece"], "enter": e, "edits": a} for p, (e, a) in zip(pieces, taken, strict=True)]}


def _replay(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                _, turns = replay(r["enter"], r["edits"], r["roles"], r["texts"])
                out.append({"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"],
                            "turns": [{"role": a, "text": b, "edit": c} for a, b, c in turns]})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _with_id(conv_id: T.DataType, rest: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv_id", conv_id), *T.StructType.fromDDL(rest).fields])
    return schema, to_arrow_schema(schema)


def faults(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with a number of their own and what is wrong with each: blank, cut (its last
    character but white space ends no sentence), again (role and text stand in an earlier row of the conversation)."""
    bare = F.rtrim("text", F.lit(SPACES))
    last = F.right(bare, F.lit(1))
    digest = F.md5(F.concat(F.md5("role"), F.md5("text")))
    rows = stored(rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).select("*", digest.alias("digest"), (bare == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("row")))
    # order of rows: turn, nulls first, then whatever tells rows of one turn apart
    rank = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("row"))
    repeated = rows.filter("NOT blank").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_first")).filter("_n > 1")
    found = rows.join(repeated, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    return found.select("conv_id", "turn", "role", "text", "digest", "row", "blank", "cut", F.coalesce(rank > F.col("_first"), F.lit(False)).alias("again"))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two tables for the conversations of `rows` (conv_id, turn, role, text; other columns are ignored).

    The first has one row per conv_id: gaps (turn numbers missing between the least and greatest), n_rows, blank, duplicate,
    truncated (first fault of each row, in this order), illegal (neighbours whose role initials are not su, ua or au), cost
    and audit of the cheapest edits, of equally cheap ones the least audit. The second has the repaired conversations in pieces:
    conv_id, part, piece (their order), turns (role, text, edit).

    Rows are taken by turn, null turns first; rows of one turn by role and digest of role and text. An empty role fits no pattern. Null roles and texts
    count as one space, a null conv_id is a conversation of its own. Repeated rows are duplicates of their first. Texts of
    any length are kept whole. An empty table gives empty ones.
    """
    conv = rows.schema["conv_id"].dataType
    ordered = faults(rows).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "row").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "row")
    schema, arrow = _with_id(conv, PIECE)
    pieces = stored(ordered.select("conv_id", "turn", "role", "text", "blank", "cut", "again").mapInArrow(_pieces(arrow, piece_rows), schema))
    bare = F.struct(*[c for c in pieces.columns if c not in ("conv_id", "roles", "texts")])
    schema, arrow = _with_id(conv, (
        "gaps bigint, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
        "taken array<struct<part: int, piece: bigint, enter: string, edits: string>>"))
    solved = stored(pieces.groupBy("conv_id").agg(F.collect_list(bare).alias("pieces")).mapInArrow(_solve(arrow), schema))
    taken = solved.select(F.inline("taken"))
    schema, arrow = _with_id(conv, "part int, piece bigint, turns array<struct<role: string, text: string, edit: string>>")
    repaired = pieces.select("conv_id", "part", "piece", "roles", "texts").join(taken, ["part", "piece"])
    repaired = repaired.select("conv_id", "part", "piece", "roles", "texts", "enter", "edits").mapInArrow(_replay(arrow), schema)
    return solved.drop("taken"), repaired


def _hashes(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, began = None, None, False
        for batch in batches:
            out = []
            for conv_id, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if digest is None or conv_id != conv:
                    if digest is not None:
                        out.append({"conv_id": conv, "sha256": digest.hexdigest()})
                    conv, digest, began = conv_id, hashlib.sha256(), False
                if lines is not None:
                    digest.update(((b"\n" if began else b"") + lines.encode()))
                    began = True
            yield pa.RecordBatch.from_pylist(out, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha256": digest.hexdigest()}], schema)
    return run


def transcript_hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation written as `role:text` lines. Pieces pass one after the other, so that a
    conversation's text is never held whole."""
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    lines = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", line), "\n"))
    rows = repaired.select("conv_id", "part", "piece", lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    schema, arrow = _with_id(repaired.schema["conv_id"].dataType, "sha256 string")
    return rows.select("conv_id", "lines").mapInArrow(_hashes(arrow), schema)


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text; nulls of the last two as one space) with faults put in by crc32 of `conv_id:turn`,
    nulls there as one space, modulo 20: 0 drops the row, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 makes it the user's."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    times: Column = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(plain("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")
