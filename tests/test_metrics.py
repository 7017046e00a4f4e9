"""Metrics and series on small tables with hand-worked results."""

import random
from datetime import date, timedelta

import pytest

from pyspark.sql import functions as F

from sentinela.operators import metrics as m
from sentinela.operators import series as s
from sentinela.plans.report import series_by_end

COLUMNS = "DT_SIN_PRI date, EVOLUCAO int, HOSPITAL int, UTI int, VACINA_COV int, VACINA int, SG_UF string"
TEN = [
    ("2026-01-01", 1, 1, 2, 1, 1, "SP"), ("2026-01-02", 2, 1, 1, 1, 2, "SP"), ("2026-01-05", 1, 1, 1, 2, 1, "RJ"),
    ("2026-01-10", 2, 2, 1, 1, 1, "SP"), ("2026-01-15", 1, 1, 2, 2, 2, "RJ"), ("2026-01-20", 3, 1, 1, 1, 1, "SP"),
    ("2026-01-25", 9, 1, 2, 1, 2, "RJ"), ("2026-01-28", 1, 2, 2, 2, 1, "SP"), ("2026-02-01", 2, 1, 1, 1, 1, "RJ"),
    ("2026-02-05", 1, 1, 1, 2, 2, "SP"),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(date.fromisoformat(r[0]), *r[1:]) for r in TEN], COLUMNS)


def values(df):
    return {(r.metric_key, r.component): (r.value, r.computable, r.numerator, r.denominator, r.period) for r in df.collect()}


WHOLE = "2026-01-01 to 2026-02-28"
EXPECTED = {
    ("case_growth_rate", ""): (None, False, 0, 0, "2026-02-21 to 2026-02-28"),
    ("mortality_rate", ""): (0.375, True, 3, 8, WHOLE),
    ("uti_admission_rate", ""): (0.75, True, 6, 8, WHOLE),
    ("vaccination_coverage", "covid"): (0.625, True, 5, 8, WHOLE),
    ("vaccination_coverage", "flu"): (0.5, True, 4, 8, WHOLE),
}


def test_all_metrics_in_one_pass(cases):
    assert values(m.compute_metrics(cases, "2026-01-01", "2026-02-28")) == EXPECTED
    assert values(m.compute_metrics(cases, "2026-02-28", "2026-01-01")) == EXPECTED


def test_single_metrics_agree_with_the_shared_pass(cases):
    for start, end in [("2026-01-01", "2026-02-28"), ("2026-01-20", "2026-02-01"), ("2026-01-03", "2026-01-04")]:
        shared = values(m.compute_metrics(cases, start, end))
        alone = {}
        for key in m.METRIC_KEYS:
            alone |= values(m.single_metric(cases, key, start, end))
        assert alone == shared


@pytest.mark.parametrize("end, expected", [
    ("2026-02-10", (-50.0, True, 1, 2, "2026-02-03 to 2026-02-10")),
    ("2026-01-03", (None, False, 2, 0, "2025-12-27 to 2026-01-03")),
])
def test_growth(cases, end, expected):
    assert values(m.single_metric(cases, "case_growth_rate", None, end)) == {("case_growth_rate", ""): expected}


def test_zero_rate_is_computable_and_empty_is_not(cases):
    assert values(m.compute_metrics(cases, "2026-01-20", "2026-02-01"))["mortality_rate", ""][:4] == (0.0, True, 0, 1)
    got = values(m.compute_metrics(cases.limit(0), "2026-01-01", "2026-02-28"))
    assert all(v[:4] == (None, False, 0, 0) for v in got.values()) and len(got) == 5


def test_malformed_dates_and_missing_columns(cases):
    got = values(m.compute_metrics(cases, "2026-01-01", "bad-date"))
    assert all(v == (None, False, 0, 0, "2026-01-01 to bad-date") for v in got.values())
    got = values(m.compute_metrics(cases, "01/01", "2026-02-10"))
    assert got["case_growth_rate", ""] == (-50.0, True, 1, 2, "2026-02-03 to 2026-02-10")
    assert got["mortality_rate", ""][:4] == (None, False, 0, 0)
    got = values(m.compute_metrics(cases.drop("DT_SIN_PRI"), "2026-01-01", "2026-02-10"))
    assert got["case_growth_rate", ""] == (None, False, 0, 0, "2026-02-03 to 2026-02-10") and len(got) == 5
    got = values(m.compute_metrics(cases.drop("HOSPITAL"), "2026-01-01", "2026-02-28"))
    assert got["mortality_rate", ""] == EXPECTED["mortality_rate", ""]
    assert got["uti_admission_rate", ""][:4] == got["vaccination_coverage", "flu"][:4] == (None, False, 0, 0)


def test_failures_stay_with_their_metric(spark, cases):
    assert values(m.compute_metrics_isolated(cases, "2026-01-01", "2026-02-28")) == EXPECTED
    broken = cases.withColumn("UTI", F.when(F.col("UTI") == 1, "x").otherwise(F.col("UTI").cast("string")))
    broken = broken.withColumn("UTI", F.col("UTI").cast("int"))
    got = values(m.compute_metrics_isolated(broken, "2026-01-01", "2026-02-28"))
    assert got["uti_admission_rate", ""] == (None, False, 0, 0, WHOLE)
    assert {k: v for k, v in got.items() if k[0] != "uti_admission_rate"} == {
        k: v for k, v in EXPECTED.items() if k[0] != "uti_admission_rate"}


def as_text(cases):
    return cases.select(*[F.col(c).cast("string").alias(c) for c in cases.columns])


def test_values_that_cannot_be_read_cost_only_their_metrics(spark, cases):
    text = as_text(cases)
    assert values(m.isolated_metrics(text, "2026-01-01", "2026-02-28")) == EXPECTED == values(m.isolated_metrics(cases, "2026-02-28", "2026-01-01"))
    fallback = (None, False, 0, 0, WHOLE)
    at = lambda day, column, value: text.withColumn(column, F.when(F.col("DT_SIN_PRI") == day, value).otherwise(F.col(column)))
    for column, value, lost in [
        ("UTI", "sim", {"uti_admission_rate"}), ("HOSPITAL", "1,5", {"uti_admission_rate", "vaccination_coverage"}), ("UTI", "1.5", {"uti_admission_rate"}),
        ("VACINA", "x", {"vaccination_coverage"}), ("EVOLUCAO", "99999999999", {"mortality_rate"}), ("UTI", "NA", set()), ("EVOLUCAO", "2.0", set()),
    ]:
        rows = m.isolated_metrics(at("2026-01-10", column, value), "2026-01-01", "2026-02-28").collect()
        assert {r.metric_key for r in rows if r.failed} == lost
        assert all(r.unreadable == (r.metric_key in lost) for r in rows)
        for r in rows:
            got = (r.value, r.computable, r.numerator, r.denominator, r.period)
            if r.metric_key in lost:
                assert got == fallback
            elif value not in ("NA", "2.0"):
                assert got == EXPECTED[r.metric_key, r.component]
    # a bad code outside of the window is no one's loss, a bad onset is everyone's
    outside = m.isolated_metrics(at("2026-01-01", "UTI", "x"), "2026-01-02", "2026-02-28").collect()
    assert not any(r.failed for r in outside)
    lost = m.isolated_metrics(at("2026-01-10", "DT_SIN_PRI", "10/01/2026"), "2026-01-01", "2026-02-28").collect()
    assert all(r.failed and r.unreadable == 1 and r.denominator == 0 for r in lost) and len(lost) == 5


def test_isolation_by_group_and_missing_columns(spark, cases):
    text = as_text(cases).withColumn("UTI", F.when(F.col("SG_UF") == "RJ", "?").otherwise(F.col("UTI")))
    rows = m.isolated_metrics(text, "2026-01-01", "2026-02-28", by=["SG_UF"]).collect()
    assert {(r.SG_UF, r.metric_key, r.unreadable) for r in rows if r.failed} == {("RJ", "uti_admission_rate", 4)}
    want = {(r.SG_UF, r.metric_key, r.component): r.value for r in m.compute_metrics(cases, "2026-01-01", "2026-02-28", by=["SG_UF"]).collect()}
    assert {(r.SG_UF, r.metric_key, r.component): r.value for r in rows if not r.failed} == {
        k: v for k, v in want.items() if k[:2] != ("RJ", "uti_admission_rate")}
    rows = m.isolated_metrics(text.drop("HOSPITAL"), "2026-01-01", "2026-02-28").collect()
    assert {r.metric_key for r in rows if r.failed} == {"uti_admission_rate", "vaccination_coverage"}
    assert all(r.failed for r in m.isolated_metrics(text.drop("DT_SIN_PRI"), "2026-01-01", "2026-02-28").collect())
    none = m.isolated_metrics(text.filter("false"), "2026-01-01", "2026-02-28").collect()
    assert len(none) == 5 and not any(r.failed or r.computable for r in none)


def test_isolation_runs_no_action_and_reads_once(spark, cases, tmp_path):
    as_text(cases).write.parquet(str(tmp_path / "t"))
    stages = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    stored = spark.read.parquet(str(tmp_path / "t"))
    before = set(stages())
    plan = m.isolated_metrics(stored, "2026-01-01", "2026-02-28")._jdf.queryExecution().executedPlan().toString()
    assert set(stages()) == before and plan.count("FileScan") == 1


def test_missing_metric_rows_are_completed(cases):
    found = m.compute_metrics(cases, "2026-01-01", "2026-02-28").filter("metric_key <> 'mortality_rate'")
    groups = cases.sparkSession.createDataFrame([(1,), (2,)], "report_id int")
    both = m.complete_metrics(found.withColumn("report_id", F.lit(1)), groups, ["report_id"], F.lit(WHOLE))
    done = both.filter("report_id = 1")
    assert all(v == (None, False, 0, 0, WHOLE) for v in values(both.filter("report_id = 2")).values()) and both.count() == 10
    want = EXPECTED | {("mortality_rate", ""): (None, False, 0, 0, WHOLE)}
    assert values(done) == want
    assert {r.definition_ref for r in done.collect() if r.metric_key == "mortality_rate"} == {"mortality_rate_v1"}


def test_by_region(cases):
    got = {(r.SG_UF, r.metric_key, r.component): r.value for r in m.compute_metrics(cases, "2026-01-01", "2026-02-28", by=["SG_UF"]).collect()}
    assert got["SP", "mortality_rate", ""] == 0.4 and got["RJ", "mortality_rate", ""] == 0.3333


@pytest.mark.parametrize("min_rows", [50_000, 3])
def test_many_periods_agree_with_one_by_one(spark, min_rows):
    """Most cases fall on one day, and many reports share a period."""
    rng = random.Random(7)
    first = date(2024, 1, 1)
    rows = [
        (None if rng.random() < 0.02 else first + timedelta(100 if rng.random() < 0.4 else rng.randrange(200)),
         rng.choice([1, 2, 3, 9, None]), rng.choice([1, 2, None]), rng.choice([1, 2]), rng.choice([1, 2]), rng.choice([1, 2, 9]), "SP")
        for _ in range(3000)
    ]
    cases = spark.createDataFrame(rows, COLUMNS).cache()
    spans = [("2024-02-01", "2024-03-01"), ("2024-04-20", "2024-04-01"), ("2023-01-01", "2025-01-01"), ("2024-04-10", "2024-04-10"),
             ("2024-04-11", "2024-04-12"), ("2030-01-01", "2030-02-01"), ("2024-05-01", "never")]
    reports = [(i, *spans[0 if i < 20 else i % len(spans)]) for i in range(40)]
    periods = spark.createDataFrame(reports, "report_id int, start_date string, end_date string")
    got = {}
    for r in m.metrics_by_period(cases, periods, min_rows=min_rows).collect():
        got.setdefault(r.report_id, {})[r.metric_key, r.component] = (r.value, r.computable, r.numerator, r.denominator, r.period)
    single = {span: values(m.compute_metrics(cases, *span)) for span in spans}
    assert got == {i: single[a, b] for i, a, b in reports}


def test_series(spark):
    days = spark.range(400).selectExpr("date_add(DATE'2026-01-01', CAST(id AS INT)) AS DT_SIN_PRI")
    daily = s.daily_cases(days, "2026-12-31").collect()
    assert [r.casos for r in daily] == [1] * 30 and (daily[0].label, daily[-1].label) == ("01/12", "30/12")
    monthly = s.monthly_cases(days, "2026-12-31").collect()
    assert [r.casos for r in monthly] == [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 30]
    assert monthly[0].label == "Jan/2026"
    assert [r.casos for r in s.monthly_cases(days, "2027-01-20").collect()] == [12, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31, 19]
    assert s.series_status(s.daily_cases(days, "2020-01-01")).first().marker == "No data"
    ends = spark.createDataFrame([("2026-12-31",), ("2027-01-20",), ("2026-12-31",)], "end_date string")
    both = series_by_end(days, ends).collect()
    assert len(both) == 30 + 12 + 30 + 13
    assert sum(r.casos for r in both if r.kind == "monthly" and r.end_date == "2027-01-20") == 365


def test_registry_table(spark):
    rows = m.metric_spec(spark).orderBy("position").collect()
    assert [r.metric_key for r in rows] == m.METRIC_KEYS
    assert rows[1].definition_ref == "mortality_rate_v1"
