"""Incremental refresh of stored cases, and stores that may be written again."""

import os
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from sentinela.plans import audit, report, sinks
from sentinela.sources import refresh

SCHEMA = "DT_SIN_PRI date, EVOLUCAO int, SG_UF string"


def some_cases(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(date(2026, 1, 1) + timedelta(rng.randrange(150)), rng.choice([1, 2, None]), rng.choice(["SP", "RJ", "", None])) for _ in range(n)]
    return [*rows, (None, 1, "SP"), (None, 1, "SP")]


def listing(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-") and f"{os.sep}_" not in d}


def content(df):
    return sorted(map(str, df.select("DT_SIN_PRI", "EVOLUCAO", "SG_UF").collect()))


def test_digests_do_not_depend_on_order_or_files_but_on_every_value(spark):
    rows = some_cases()
    base = {r.onset_month: r.digest for r in refresh.month_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    again = {r.onset_month: r.digest for r in refresh.month_digests(spark.createDataFrame(shuffled, SCHEMA).repartition(7)).collect()}
    assert base == again and None in base
    changes = [(0, "add", rows[0]), (1, "drop", None), (2, "null", (rows[2][0], rows[2][1], None if rows[2][2] else "x")), (3, "code", (rows[3][0], 9, rows[3][2]))]
    for k, kind, new in changes:
        other = rows + [new] if kind == "add" else rows[:k] + ([new] if new else []) + rows[k + 1 :]
        found = {r.onset_month: r.digest for r in refresh.month_digests(spark.createDataFrame(other, SCHEMA)).collect()}
        assert {m for m in base if base[m] != found.get(m)} == {f"{rows[k][0]:%Y-%m}"}, kind


def test_values_that_read_alike_differ(spark):
    pairs = [(("a,1", "b"), ("a", "1,b")), (("", None), (None, "")), (("-", "x"), (None, "x")), (("1:a", ""), ("1", ":a"))]
    for one, two in pairs:
        digests = {r.d for r in spark.createDataFrame([one, two], "x string, y string").select(refresh.row_digest(["x", "y"]).alias("d")).collect()}
        assert len(digests) == 2


def test_only_changed_months_are_written(spark, tmp_path):
    path, rows = str(tmp_path / "cases"), some_cases()
    first = refresh.refresh_cases(spark.createDataFrame(rows, SCHEMA), path, "2026-07-01")
    assert {r.change for r in first.collect()} == {"added"} and content(refresh.read_cases(spark, path)) == content(spark.createDataFrame(rows, SCHEMA))
    before = listing(path)

    # March has another outcome, April is gone, a case without onset comes on top, June is new
    later = [(d, 9 if d and d.month == 3 and k == next(i for i, r in enumerate(rows) if r[0] and r[0].month == 3) else e, s)
             for k, (d, e, s) in enumerate(rows) if not (d and d.month == 4)]
    later += [(None, 2, "RJ"), (date(2026, 6, 3), 1, "SP")]
    changes = {r.onset_month: r.change for r in refresh.refresh_cases(spark.createDataFrame(later, SCHEMA).repartition(5), path, "2026-07-02").collect()}
    assert changes == {"2026-01": "same", "2026-02": "same", "2026-03": "changed", "2026-04": "removed", "2026-05": "same", None: "changed", "2026-06": "added"}
    after = listing(path)
    kept = {f for f in before if any(f"onset_month=2026-0{m}" in f for m in (1, 2, 4, 5))}
    assert kept and {f: after[f] for f in kept} == {f: before[f] for f in kept}
    assert not {f for f in before if "onset_month=2026-03" in f or "HIVE_DEFAULT" in f} & set(after)
    assert content(refresh.read_cases(spark, path)) == content(spark.createDataFrame(later, SCHEMA))

    again = refresh.refresh_cases(spark.createDataFrame(later, SCHEMA), path, "2026-07-02")
    assert {r.change for r in again.collect()} == {"same"} and listing(path) == after


def test_a_refresh_that_breaks_off_is_made_good(spark, tmp_path):
    path, rows = str(tmp_path / "cases"), some_cases()
    refresh.refresh_cases(spark.createDataFrame(rows, SCHEMA), path, "1")
    # another state's rows got into January, and the digests were never written
    spark.createDataFrame(rows[:3], SCHEMA).withColumn("onset_month", F.lit("2026-01")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("onset_month").parquet(path)
    later = [*rows, (date(2026, 1, 2), 1, "MG")]
    refresh.refresh_cases(spark.createDataFrame(later, SCHEMA), path, "2")
    assert content(refresh.read_cases(spark, path)) == content(spark.createDataFrame(later, SCHEMA))


def test_no_cases(spark, tmp_path):
    path = str(tmp_path / "cases")
    refresh.refresh_cases(spark.createDataFrame(some_cases(), SCHEMA), path, "1")
    changes = refresh.refresh_cases(spark.createDataFrame([], SCHEMA), path, "2")
    assert {r.change for r in changes.collect()} == {"removed"} and refresh.read_cases(spark, path).count() == 0


RECORD = "run_id string, timestamp string, error string"


def test_a_run_written_twice_has_one_record(spark, tmp_path):
    path = str(tmp_path / "audit")
    one = spark.createDataFrame([(f"r{i}", "2026-07-20T00:00:00", None) for i in range(50)], RECORD)
    name = audit.write_audit(one, path)
    assert audit.write_audit(one.withColumn("error", F.lit("later")).repartition(3), path) == name
    stored = spark.read.json(path)
    assert stored.count() == 50 and {r.error for r in stored.collect()} == {"later"}


def test_the_latest_record_of_a_run_counts(spark, tmp_path):
    path = str(tmp_path / "audit")
    audit.write_audit(spark.createDataFrame([("a", "2026-07-20T00:00:00", "x"), ("b", "2026-07-20T00:00:00", None)], RECORD), path)
    audit.write_audit(spark.createDataFrame([("a", "2026-07-21T00:00:00", None), ("c", "2026-07-21T00:00:00", "z")], RECORD), path)
    audit.write_audit(spark.createDataFrame([], RECORD), path)
    got = {r.run_id: (r.timestamp[:10], r.error) for r in audit.read_audit(spark, path, f"{RECORD}, batch string").collect()}
    assert got == {"a": ("2026-07-21", None), "b": ("2026-07-20", None), "c": ("2026-07-21", "z")}


def test_named_batches_and_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    schema = "report_id int, run_id string, report string"
    report.write_reports(spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], schema), path, "day-1")
    report.write_reports(spark.createDataFrame([(1, "a", "new")], schema), path, "day-2")
    assert {r.run_id: r.report for r in report.read_reports(spark, path).collect()} == {"a": "new", "b": "old"}
    report.write_reports(spark.createDataFrame([(2, "b", "again")], schema), path, "day-1")
    assert {r.run_id: r.report for r in report.read_reports(spark, path).collect()} == {"a": "new", "b": "again"}


def test_batch_names(spark):
    frame = lambda *keys: spark.createDataFrame([(k,) for k in keys], "run_id string")
    names = [sinks.batch_name(f) for f in (frame("a", "b"), frame("b", "a"), frame("a", "b", "b"), frame(), frame(None), frame("ab"))]
    assert names[0] == names[1] and len(set(names[1:])) == 5
