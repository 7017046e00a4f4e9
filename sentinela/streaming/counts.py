"""Case counts, reporting triangles and news cleaning on streams of newly arrived rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.operators.sanitize import sanitize_items


def daily_case_stream(cases: DataFrame, time_column: str, delay: str = "14 days") -> DataFrame:
    """Cases per day of a stream; a day is final once the watermark passes it.

    Late notifications are counted as long as they arrive within `delay`; state is one row per open day.
    """
    day = F.window(F.col(time_column), "1 day")
    counted = cases.withWatermark(time_column, delay).groupBy(day.alias("w")).agg(F.count(F.lit(1)).alias("casos"))
    return counted.select(F.col("w.start").cast("date").alias("data"), "casos")


def triangle_stream(cases: DataFrame, onset: str, notified: str, by: Sequence[str] = (), late: str = "2 days") -> DataFrame:
    """(by, onset, delay, cases): cells of the reporting triangle as cases are notified, for `operators/delays.py`.

    `notified` is a timestamp. All cases of a cell are notified on one day, onset plus delay, so a cell is final once the
    watermark passes that day, and is put out once, in append mode; state is the cells of the open days. Cases without onset,
    or notified before it, are in no cell; one that arrives more than `late` after its day has passed is dropped by the watermark.
    """
    delay = F.datediff(notified, onset)
    usable = cases.withWatermark(notified, late).filter(delay >= 0)
    counted = usable.groupBy(F.window(notified, "1 day").alias("w"), *by, delay.alias("delay")).agg(F.count(F.lit(1)).alias("cases"))
    return counted.select(*by, F.date_sub(F.col("w.start").cast("date"), F.col("delay")).alias("onset"), "delay", "cases")


def sanitized_item_stream(news: DataFrame) -> DataFrame:
    """Items of a stream flagged and cleaned as they arrive; no state is kept."""
    return sanitize_items(news)
