"""Daily and monthly case series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.functions.dates import day_label, month_label
from sentinela.functions.rounding import round_exact_sql
from sentinela.schema import DAILY_WINDOW_DAYS, GROWTH_DAYS, GROWTH_DIGITS, MONTHLY_WINDOW_DAYS, ONSET


def cases_between(cases: DataFrame, start: date, end: date) -> DataFrame:
    """Cases with onset in `[start, end)`; the bounds are literals, so they reach the scan."""
    return cases.filter((F.col(ONSET) >= F.lit(start)) & (F.col(ONSET) < F.lit(end)))


def daily_cases(cases: DataFrame, end_date: str, window_days: int = DAILY_WINDOW_DAYS) -> DataFrame:
    """Cases per day over the days before `end_date`, in date order. Days without a case have no row."""
    end = date.fromisoformat(end_date)
    scope = cases_between(cases, end - timedelta(window_days), end)
    counted = scope.groupBy(F.col(ONSET).alias("data")).agg(F.count(F.lit(1)).alias("casos"))
    return counted.select("data", day_label(F.col("data")).alias("label"), "casos").orderBy("data")


def monthly_cases(cases: DataFrame, end_date: str, window_days: int = MONTHLY_WINDOW_DAYS) -> DataFrame:
    """Cases per month over the 365 days before `end_date`; the first and last month may be partial."""
    end = date.fromisoformat(end_date)
    scope = cases_between(cases, end - timedelta(window_days), end)
    counted = scope.groupBy(F.trunc(ONSET, "month").alias("mes")).agg(F.count(F.lit(1)).alias("casos"))
    return counted.select("mes", month_label(F.col("mes")).alias("label"), "casos").orderBy("mes")


def daily_by_group(cases: DataFrame, by: Sequence[str], start_date: str, end_date: str) -> DataFrame:
    """(by, data, label, casos): every day of `[start_date, end_date)` once for every group of the whole table, 0 without cases.

    The cases are counted once per group and day, whatever lies outside the window as no day, so a group without a case in it
    is known too. A group's days, as many as the window has at most, are gathered and looked up: no join with a calendar.
    """
    start, end = sorted((date.fromisoformat(start_date), date.fromisoformat(end_date)))
    inside = F.when((F.col(ONSET) >= F.lit(start)) & (F.col(ONSET) < F.lit(end)), F.col(ONSET))
    counted = cases.groupBy(*by, inside.alias("data")).agg(F.count(F.lit(1)).alias("casos"))
    days = F.map_from_entries(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("data", "casos"))))
    calendar = F.sequence(F.lit(start), F.lit(end - timedelta(1))) if start < end else F.array().cast("array<date>")
    filled = counted.groupBy(*by).agg(days.alias("days")).select(*by, "days", F.explode(calendar).alias("data"))
    casos = F.coalesce(F.try_element_at("days", "data"), F.lit(0).cast("bigint"))
    return filled.select(*by, "data", day_label(F.col("data")).alias("label"), casos.alias("casos"))


def growth_by_day(cases: DataFrame, by: Sequence[str] = (), days: int = GROWTH_DAYS) -> DataFrame:
    """(by, day, current, prior, value, computable): case growth over the `days` up to and with each day that has cases, against
    the `days` before them. Days without cases count as 0: windows are ranges of dates, not of rows.

    The cases shrink to day counts first, so a group's window holds one row per calendar day at most.
    """
    counts = cases.filter(F.col(ONSET).isNotNull()).groupBy(*by, F.col(ONSET).alias("day")).agg(F.count(F.lit(1)).alias("cases"))
    number = F.datediff("day", F.lit(date(1970, 1, 1)))
    dates = Window.partitionBy(*by).orderBy(number)
    within = lambda first, last: F.coalesce(F.sum("cases").over(dates.rangeBetween(first, last)), F.lit(0))
    grown = counts.select(*by, "day", within(1 - days, 0).alias("current"), within(1 - 2 * days, -days).alias("prior"))
    value = round_exact_sql("(current - prior) / nullif(prior, 0) * 100", GROWTH_DIGITS)
    return grown.withColumn("value", F.expr(f"CASE WHEN prior > 0 THEN {value} END")).withColumn("computable", F.col("prior") > 0)


def series_status(series: DataFrame) -> DataFrame:
    """One row telling whether a series has data; an empty one is shown as "No data"."""
    return series.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("casos"), F.lit(0)).alias("casos")).select(
        F.when(F.col("points") == 0, "No data").alias("marker"), "points", "casos"
    )
