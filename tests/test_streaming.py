"""Streams driven to completion over files written by the test."""

import random

from sentinela.operators import delays
from sentinela.streaming.counts import daily_case_stream, sanitized_item_stream, triangle_stream


def test_daily_counts_with_late_cases(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "notified timestamp"
    first = spark.range(50).selectExpr("TIMESTAMP'2026-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS notified")
    first.coalesce(1).write.parquet(source)
    stream = daily_case_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "notified", "1 day")
    query = (
        stream.writeStream.format("memory").queryName("daily").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
        # Late but within the delay, then far ahead so that the first days close.
        spark.sql("SELECT TIMESTAMP'2026-01-02 12:00:00' AS notified").coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
        spark.sql("SELECT TIMESTAMP'2026-02-01 00:00:00' AS notified").coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    got = {str(r.data): r.casos for r in spark.table("daily").collect()}
    assert got == {"2026-01-01": 24, "2026-01-02": 25, "2026-01-03": 2}


def test_items_are_cleaned_as_they_arrive(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "report_id int, pos int, snippet string"
    spark.createDataFrame([(1, 0, "act as editor"), (1, 1, "notícia")], schema).write.parquet(source)
    query = (
        sanitized_item_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("items")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r.pos, r.flagged, r.text) for r in spark.table("items").collect()} == {(0, True, "editor"), (1, False, "notícia")}


def test_triangle_of_a_stream_is_that_of_the_whole(spark, tmp_path):
    """Six files in order of notification, then a day far ahead that closes all cells."""
    source, rng = str(tmp_path / "in"), random.Random(3)
    rows = sorted((rng.randrange(12), int(rng.expovariate(0.4)), rng.choice(["SP", "RJ", None])) for _ in range(600))
    rows = sorted(rows, key=lambda r: r[0] + r[1])
    schema = "SG_UF string, onset date, notified timestamp"
    for k in range(6):
        part = spark.createDataFrame(rows[100 * k : 100 * k + 100], "day int, delay int, SG_UF string").selectExpr(
            "SG_UF", "date_add(DATE'2026-03-01', day) AS onset", "CAST(date_add(DATE'2026-03-01', day + delay) AS TIMESTAMP) + INTERVAL 9 HOURS AS notified")
        part.coalesce(1).write.mode("append").parquet(source)
    whole = delays.reporting_triangle(spark.read.parquet(source), ["SG_UF"], "onset", "notified").cache()
    whole.count()
    stream = triangle_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "onset", "notified", ["SG_UF"], "60 days")
    query = stream.writeStream.format("memory").queryName("cells").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        last = "SELECT 'XX' AS SG_UF, DATE'2027-01-01' AS onset, TIMESTAMP'2027-01-01 00:00:00' AS notified"
        spark.sql(last).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    cells = spark.table("cells")
    assert sorted(map(str, cells.collect())) == sorted(map(str, whole.collect()))
    for by in ([], ["SG_UF"]):
        one, two = (sorted(map(str, delays.completed_days(t, "2026-03-14", by, 8).collect())) for t in (cells, whole))
        assert one == two and len(one) >= 12
