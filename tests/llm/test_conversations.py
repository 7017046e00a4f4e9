import hashlib
import itertools
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentinela.llm.conversation_repair import END, STATES, damaged, joined, lightest, repair, replay, transcript_hashes

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, piece string, `row` int"


def legal(s):
    s = s.removeprefix("s")
    return len(s) % 2 == 0 and s == "ua" * (len(s) // 2)


def plain_best(rows):
    """All edits of each row, with up to two insertions before each and after the last; the cheapest, then the least audit."""
    options = []
    for initial, gone, cut in rows:
        more = 3 * cut
        one = [("D", "", 4)]
        if not gone:
            one += [("K", initial or "?", more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        options.append(one)
    inserts = [("", "", 0), *(("I", x, 3) for x in "ua"), *(("II", x + y, 6) for x in "ua" for y in "ua")]
    best = None
    for picked in itertools.product(*options):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            symbols = audit = ""
            cost = 0
            for fill, edit in zip(added, [*picked, ("", "", 0)], strict=True):
                symbols += fill[1] + edit[1]
                audit += fill[0] + edit[0]
                cost += fill[2] + edit[2]
            if (symbols == "" or (legal(symbols) and symbols != "s")) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def stepwise(rows):
    """The same by a table over rows and states, quick enough for long conversations."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    def filled(table):
        for _ in range(3):
            for q, (c, a) in list(table.items()):
                table[following[q]] = min(table.get(following[q], (10**9, "")), (c + 3, a + "I"))
        return table
    table = {"": (0, "")}
    for initial, gone, cut in rows:
        after = {}
        for q, (c, a) in filled(dict(table)).items():
            moves = [(q, 4, "D")]
            if not gone:
                moves.append((following[q], 3 + 3 * cut, "R"))
                if initial == following[q] or (q == "" and initial == "s"):
                    moves.append((initial, 3 * cut, "K"))
            for to, more, letter in moves:
                after[to] = min(after.get(to, (10**9, "")), (c + more, a + letter))
        table = after
    table = filled(dict(table))
    return min(table[q] for q in ("", "a") if q in table)


row_codes = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans())


@settings(max_examples=150, deadline=None)
@given(st.lists(row_codes, max_size=2))
def test_lightest_against_all_edits(rows):
    assert lightest(rows, "", (END,))[END] == plain_best(rows) == stepwise(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(row_codes, max_size=40), st.lists(st.integers(1, 7), max_size=40))
def test_pieces_give_what_the_whole_gives(rows, sizes):
    cuts, at = [], 0
    for size in sizes:
        cuts.append(rows[at : at + size])
        at += size
    cuts = [c for c in [*cuts, rows[at:]] if c] or [[]]
    spans = []
    for k, cut in enumerate(cuts):
        enters, leaves = ("",) if k == 0 else STATES, (*STATES, END)
        spans.append({(e, to): v for e in enters for to, v in lightest(cut, e, leaves).items()})
    cost, taken = joined(spans)
    audit = "".join(a for _, a in taken)
    assert (cost, audit) == stepwise(rows) == lightest(rows, "", (END,))[END]
    state = ""
    for (enter, part), cut in zip(taken, cuts, strict=True):
        assert enter == state
        state, _ = replay(enter, part, [r[0] for r in cut], ["x"] * len(cut))
    assert state in ("", "a")


def test_values_only_grow_along_deductions():
    from sentinela.llm.conversation_repair import deductions

    rows = [("u", False, True), ("a", False, False), ("s", True, False)]
    for place, state in itertools.product(range(4), STATES):
        for _, more, initial in deductions(rows, place, state, False):
            for value in [(0, ""), (3, "KR"), (3, "KRI")]:
                assert (value[0] + more, value[1] + initial) >= value


def order_key(r):
    md = lambda x: hashlib.md5(x.encode()).hexdigest()
    return (r[1] is not None, r[1] or 0, r[2], md(md(r[2]) + md(r[3])))


def plain_repair(rows):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows if c == conv), key=order_key)
        seen, codes, count = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in mine:
            bare = text.rstrip(SPACES)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            codes.append((role[:1], fault in ("b", "d") and bool(fault), fault == "t"))
        turns = {t for _, t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
        cost, audit = stepwise(codes)
        _, turns_left = replay("", audit, [r[2] for r in mine], [r[3] for r in mine])
        out[conv] = (gaps, *count.values(), illegal, cost, audit, "\n".join(f"{a}:{b}" for a, b, _ in turns_left))
    return out


def check(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA).repartition(3)
    solved, repaired = repair(frame, **settings)
    hashes = {r.conv_id: r.sha256 for r in transcript_hashes(repaired).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in solved.collect()}
    want = plain_repair(rows)
    assert got == {k: v[:-1] for k, v in want.items()}
    assert hashes == {k: hashlib.sha256(v[-1].encode()).hexdigest() for k, v in want.items()}


def made(rng, conv, n):
    rows = []
    for t in range(n):
        role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""])
        text = rng.choice([f"Line {t}.", "Again!", "Again!", " \n", "no end", f"cut {t}", "ends?  \n"])
        rows.append((conv, rng.choice([t, t + 1]), role, text))
    return rows


@pytest.mark.parametrize("piece_rows", [1, 3, 64])
def test_tables_against_plain_python(spark, piece_rows):
    rng = random.Random(piece_rows)
    rows = [r for c in range(25) for r in made(rng, c, rng.randrange(1, 12))] + made(rng, 99, 300)
    check(spark, rows, piece_rows=piece_rows)


def test_odd_rows(spark):
    check(spark, [
        (1, None, None, None), (1, None, "user", "Hi."), (None, 3, "user", "Who?"), (None, 9, "assistant", "Me."), (2, 5, "user", ""),
        (3, 1, "system", "S."), (3, 2, "user", "word " * 60_000 + "."), (3, 2, "user", "word " * 60_000 + "."), (3, 2, "assistant", "A "),
        (4, -5, "assistant", "é."), (4, 7, "user", "\U0001F600!"), (5, None, "user", "x"), (5, None, "assistant", "y")])


def test_equal_rows_lie_in_many_tasks(spark):
    check(spark, [(7, 1, "user", "Same.")] * 700 + [(7, 2, "assistant", "Yes.")] * 300, piece_rows=8)


def test_empty_table(spark):
    solved, repaired = repair(spark.createDataFrame([], SCHEMA))
    assert solved.count() == 0 and transcript_hashes(repaired).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in damaged(spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)).collect() if r.conv_id is not None)
    want = []
    for c, t, role, text in rows[:-1]:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        one = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two Three" if kind == 2 else text)
        want += [one] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want) and zlib.crc32(b" : ") % 20 > 4
