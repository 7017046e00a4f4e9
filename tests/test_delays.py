"""Reporting triangle and completion against plain arithmetic."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest

from sentinela.operators import delays

FIRST = date(2026, 3, 1)
SCHEMA = "DT_SIN_PRI date, DT_NOTIFIC date, SG_UF string"


def plain_share(cells, as_of, max_delay):
    """cells {(onset, delay): n} of one group; share of cases known by delay, ratio by ratio."""
    known = Counter()
    for (onset, delay), n in cells.items():
        if onset + timedelta(delay) <= as_of:
            known[onset, min(delay, max_delay)] += n
    shares = [1.0]
    for k in range(max_delay, 0, -1):
        old = [(d, n) for (onset, d), n in known.items() if (as_of - onset).days >= k]
        within, before = sum(n for d, n in old if d <= k), sum(n for d, n in old if d < k)
        shares.insert(0, shares[0] * (before / within if within else 1.0))
    return known, shares


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for _ in range(4000):
        onset = FIRST + timedelta(rng.randrange(40))
        out.append((onset, onset + timedelta(int(rng.expovariate(0.15))), rng.choice(["SP", "SP", "SP", "RJ", None])))
    out += [(None, FIRST, "SP"), (FIRST, None, "SP"), (None, None, None), (FIRST, FIRST - timedelta(1), "RJ")] * 3
    return out + [(FIRST + timedelta(39), FIRST + timedelta(39), "AC")] * 5


@pytest.mark.parametrize("max_delay", [1, 12, 60])
@pytest.mark.parametrize("by", [[], ["SG_UF"]])
def test_shares_and_completed_days(spark, rows, by, max_delay):
    triangle = delays.reporting_triangle(spark.createDataFrame(rows, SCHEMA), by)
    as_of = FIRST + timedelta(39)
    got = {(*(r[c] for c in by), r.onset): (r.reported, r.age, r.share, r.expected) for r in delays.completed_days(triangle, str(as_of), by, max_delay).collect()}
    want = {}
    for group in {r[2] for r in rows} if by else {None}:
        mine = [r for r in rows if not by or r[2] == group]
        cells = Counter((o, (n - o).days) for o, n, _ in mine if o and n and n >= o)
        known, shares = plain_share(cells, as_of, max_delay)
        for onset in {o for o, _ in known}:
            n, age = sum(v for (o, _), v in known.items() if o == onset), (as_of - onset).days
            share = round(shares[min(age, max_delay)], 6)
            want[(group, onset) if by else (onset,)] = (n, age, share, round(n / share, 3) if share else None)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    for k, v in want.items():
        assert got[k][2] == pytest.approx(v[2], abs=2e-6) and (got[k][3] == v[3] or got[k][3] == pytest.approx(v[3], rel=1e-5))


def test_completion_recovers_the_delayed_cases(spark):
    """Every onset day has 100 cases, a fifth of them known each day: two days are enough to see it."""
    rows = [(FIRST + timedelta(d), FIRST + timedelta(d + k % 5), "SP") for d in range(20) for k in range(100)]
    days = {r.age: r for r in delays.completed_days(delays.reporting_triangle(spark.createDataFrame(rows, SCHEMA)), str(FIRST + timedelta(19)), (), 10).collect()}
    assert [days[a].reported for a in range(6)] == [20, 40, 60, 80, 100, 100]
    assert all(abs(r.expected - 100) < 0.01 for r in days.values())


def test_growth_as_reported_and_as_expected(spark):
    rows = [(FIRST + timedelta(d), FIRST + timedelta(d + k % 5), "SP") for d in range(30) for k in range(100)]
    triangle = delays.reporting_triangle(spark.createDataFrame(rows, SCHEMA), ["SG_UF"])
    r = delays.completed_growth(triangle, str(FIRST + timedelta(29)), ["SG_UF"], max_delay=10).first()
    assert (r.current, r.prior, r.value) == (580, 700, -17.14) and abs(r.expected_value) < 0.01


def test_unusable_dates(spark, rows):
    got = {r.SG_UF: (r.missing, r.reversed) for r in delays.unusable_dates(spark.createDataFrame(rows, SCHEMA), ["SG_UF"]).collect()}
    assert got == {"SP": (6, 0), None: (3, 0), "RJ": (0, 3), "AC": (0, 0)}


def test_no_cases(spark):
    triangle = delays.reporting_triangle(spark.createDataFrame([], SCHEMA), ["SG_UF"])
    assert delays.completed_days(triangle, "2026-03-10", ["SG_UF"]).count() == 0
    assert delays.completed_days(triangle.drop("SG_UF"), "2026-03-10").count() == 0


def test_one_scan_and_running_sums_per_group_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(FIRST, FIRST, "SP")], SCHEMA).write.parquet(path)
    plan = delays.delay_ratios(delays.reporting_triangle(spark.read.parquet(path), ["SG_UF"]), "2026-03-10", ["SG_UF"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
