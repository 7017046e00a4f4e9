"""Series and metrics of groups, coverage of the population, and numbers within a tolerance, against plain Python."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest

from pyspark.sql import functions as F

from sentinela.operators import coverage, nearest
from sentinela.operators import metrics as m
from sentinela.operators import series as s

FIRST = date(2026, 1, 1)
COLUMNS = "DT_SIN_PRI date, EVOLUCAO int, HOSPITAL int, UTI int, VACINA_COV int, VACINA int, SG_UF string, CS_SEXO string, NU_IDADE_N int, TP_IDADE int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for _ in range(900):
        day = None if rng.random() < 0.03 else FIRST + timedelta(rng.choice([rng.randrange(60), rng.randrange(4) * 11]))
        out.append((day, rng.choice([1, 2, 3, 9, None]), rng.choice([1, 2, None]), rng.choice([1, 2]), rng.choice([1, 2]), rng.choice([1, 2, 9]),
                    rng.choice(["SP", "SP", "RJ", None]), rng.choice(["F", "M", None]), rng.choice([None, -1, 0, 3, 12, 19, 20, 59, 60, 99, 250]), rng.choice([1, 2, 3, 3, 3, None])))
    return [*out, (FIRST - timedelta(400), 1, 1, 1, 1, 1, "AC", "F", 5, 3)]


@pytest.fixture(scope="module")
def cases(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(4)


def rate(a, b, digits=4):
    return round(a / b, digits) if b else None


@pytest.mark.parametrize("by", [[], ["SG_UF"]])
def test_growth_of_every_day(cases, rows, by):
    got = {(*(r[c] for c in by), r.day): (r.current, r.prior, r.value, r.computable) for r in s.growth_by_day(cases, by).collect()}
    days = Counter(((r[6],) if by else ()) + (r[0],) for r in rows if r[0])
    want = {}
    for *group, day in days:
        total = lambda a, b: sum(days[(*group, day - timedelta(k))] for k in range(a, b))  # noqa: E731, B023
        now, then = total(0, 7), total(7, 14)
        want[*group, day] = (now, then, round((now - then) / then * 100, 2) + 0.0 if then else None, then > 0)
    assert got == want


def test_every_day_once_for_every_group(cases, rows):
    got = {(r.SG_UF, r.data): r.casos for r in s.daily_by_group(cases, ["SG_UF"], "2026-01-20", "2026-03-20").collect()}
    days = Counter((r[6], r[0]) for r in rows)
    want = {(g, date(2026, 1, 20) + timedelta(k)): days[g, date(2026, 1, 20) + timedelta(k)] for g in ("SP", "RJ", "AC", None) for k in range(59)}
    assert got == want and 0 in want.values()
    assert s.daily_by_group(cases, ["SG_UF"], "2026-01-20", "2026-01-20").count() == 0
    assert s.daily_by_group(cases.limit(0), ["SG_UF"], "2026-01-20", "2026-02-20").count() == 0
    plan = s.daily_by_group(cases, ["SG_UF"], "2026-01-20", "2026-03-20")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def band(age, unit):
    if age is None or unit is None or age < 0:
        return None
    years = {3: age, 2: age // 12, 1: 0}[unit]
    return next((name for name, last in m.AGE_BANDS.items() if years <= last), None)


def test_all_levels_in_one_pass(spark, cases, rows, tmp_path):
    levels = [[], ["SG_UF"], ["SG_UF", "CS_SEXO"], ["age_band"]]
    banded = cases.withColumn("age_band", m.age_band())
    got = {}
    for r in m.metrics_by_level(banded, "2026-01-05", "2026-03-01", levels).collect():
        got.setdefault((r.level, r.SG_UF, r.CS_SEXO, r.age_band), {})[r.metric_key, r.component] = (r.value, r.computable, r.numerator, r.denominator, r.period)
    want = {}
    for level in levels:
        key = lambda r: (r[6] if "SG_UF" in level else None, r[7] if "CS_SEXO" in level else None, band(r[8], r[9]) if "age_band" in level else None)  # noqa: E731, B023
        inside = [r for r in rows if r[0] and date(2026, 1, 5) <= r[0] < date(2026, 3, 1)]
        for group in {key(r) for r in inside} | ({(None, None, None)} if not level else set()):
            own = spark.createDataFrame([r for r in rows if key(r) == group], COLUMNS)
            want[(",".join(level), *group)] = {
                (r.metric_key, r.component): (r.value, r.computable, r.numerator, r.denominator, r.period)
                for r in m.compute_metrics(own, "2026-01-05", "2026-03-01").collect()}
    assert got == want and len(got) > 12
    banded.write.parquet(str(tmp_path / "t"))
    plan = m.metrics_by_level(spark.read.parquet(str(tmp_path / "t")), "2026-01-05", "2026-03-01", levels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(DT_SIN_PRI,2026-01-05)" in plan


def test_as_of_join_against_a_search(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "b", None]), None if rng.random() < 0.05 else rng.randrange(40)) for i in range(300)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(40), rng.choice([None, rng.randrange(45)]), k) for k in range(40)]
    one = spark.createDataFrame(left, "i int, g string, t int").repartition(3)
    two = spark.createDataFrame(right, "g string, since int, until int, v int")
    got = {r.i: (r.since, r.until, r.v) for r in coverage.as_of_join(one, two, ["g"], "t", "since", "until").collect()}
    for i, g, t in left:
        earlier = [r for r in right if r[0] == g and t is not None and r[1] <= t]
        last = max(earlier, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3]), default=None)
        want = last[1:] if last and (last[2] is None or last[2] > t) else (None, None, None)
        assert got[i] == want, (i, g, t)
    assert coverage.as_of_join(one, two.limit(0), ["g"], "t", "since").count() == 300


def test_coverage_with_and_without_a_population(spark, cases):
    metrics = m.compute_metrics(cases, "2026-01-01", "2026-02-01", by=["SG_UF"]).withColumn("last_day", F.lit(date(2026, 1, 31)))
    schema = "SG_UF string, valid_from date, valid_to date, people bigint, covid bigint, flu bigint"
    people = spark.createDataFrame([
        ("SP", date(2024, 1, 1), date(2026, 1, 1), 10, 1, 1), ("SP", date(2026, 1, 1), None, 3000, 2000, None), ("RJ", date(2026, 2, 1), None, 500, 1, 1), ("AC", date(2020, 1, 1), None, 0, 0, 0)], schema)
    plain = {(r.SG_UF, r.component): (r.value, r.numerator, r.denominator) for r in metrics.collect() if r.metric_key == "vaccination_coverage"}
    got = {(r.SG_UF, r.component): (r.value, r.numerator, r.denominator, r.basis) for r in coverage.population_coverage(metrics, people, ["SG_UF"], "last_day").collect()}
    assert got.pop(("SP", "covid")) == (0.6667, 2000, 3000, "population")
    assert got == {k: (*v, "hospital") for k, v in plain.items() if k != ("SP", "covid")} and len(got) == 5


def brute(numbers, values, tolerance):
    return {(a + 0.0, b + 0.0) for a in numbers for b in values if a is not None and b is not None and abs(a) < 1e308 and abs(b) < 1e308
            and (abs(a) <= 0.01 if b == 0 else abs(a - b) <= tolerance * abs(b))}


@pytest.mark.parametrize("tolerance", [0.01, 0.2, 1e-6])
def test_tolerance_join_against_all_pairs(spark, tolerance):
    rng = random.Random(8)
    values = [rng.choice([1, -1]) * 10 ** rng.uniform(-6, 9) for _ in range(150)] + [0.0, -0.0, 100.0, None, 1.0, -1.0, 5e-324, 1e-300]
    numbers = [v * (1 + rng.choice([-1, 1]) * tolerance * rng.uniform(0, 1.02)) for v in values if v] + [99.0, 101.0, 101.0001, 98.9999, 0.01, -0.01, 0.0100001, 0.0, -0.0, float("inf"), float("nan"), None]
    numbers += [b * (1 + tolerance) for b in values if b] + [b * (1 - tolerance) for b in values if b]
    found = nearest.tolerance_join(spark.createDataFrame([(x,) for x in numbers * 2], "number double"), spark.createDataFrame([(x,) for x in values * 2], "value double"), tolerance)
    got = [(r.number, r.value) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(numbers, values, tolerance)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_which_metrics_a_number_states(spark):
    schema = "report_id int, metric_key string, component string, value double, computable boolean"
    metrics = spark.createDataFrame([(1, "a", "", 10.0, True), (2, "a", "", 10.05, True), (3, "a", "", 10.05, True), (4, "a", "", 10.0, False), (1, "b", "x", -3.0, True), (5, "a", "", None, False)], schema)
    numbers = spark.createDataFrame([(10.02,), (10.02,), (-3.01,), (7.0,)], "number double")
    got = {(r.number, r.metric_key, r.component): (r.reports, r.nearest) for r in nearest.stated_metrics(numbers, metrics).collect()}
    assert got == {(10.02, "a", ""): (3, 10.0), (-3.01, "b", "x"): (1, -3.0)}
