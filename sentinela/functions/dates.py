"""Dates, periods and the report year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Year and text of the news search.
DEFAULT_YEAR = "2026"
QUERY_TEMPLATE = "SRAG Síndrome Respiratória Aguda Grave surto casos %s"


def local_date(ts: Column) -> Column:
    """Calendar day in America/Sao_Paulo of an instant given as UTC wall-clock time."""
    return F.to_date(F.from_utc_timestamp(ts, "America/Sao_Paulo"))


def ordered_period(start: Column, end: Column) -> tuple[Column, Column]:
    """Swap ISO dates given the wrong way round; they compare as text."""
    return F.least(start, end), F.greatest(start, end)


def period_text(start: Column, end: Column) -> Column:
    return F.concat_ws(" to ", start.cast("string"), end.cast("string"))


def iso_date(text: Column) -> Column:
    """A strict YYYY-MM-DD or YYYYMMDD date, or NULL."""
    trimmed = F.trim(text)
    return (
        F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}\z"), trimmed.try_cast("date"))
        .when(trimmed.rlike(r"^\d{8}\z"), F.try_to_timestamp(trimmed, F.lit("yyyyMMdd")).cast("date"))
    )


def year_from_iso(text: Column) -> Column:
    return F.year(iso_date(text)).cast("string")


def year_from_period(period: Column) -> Column:
    """Year of the end of `"a to b"` (its first four digits if it is no date), or of a lone date."""
    end = F.trim(F.regexp_extract(F.trim(period), r"(?s)^.*? to (.*)$", 1))
    return F.when(
        F.trim(period).contains(" to "),
        F.coalesce(year_from_iso(end), F.when(F.left(end, F.lit(4)).rlike(r"^\d{1,4}\z"), F.left(end, F.lit(4)))),
    ).otherwise(year_from_iso(period))


def report_year(metric_years: list[Column], period_dates: list[Column]) -> Column:
    """First known year over the metrics' periods, then over the report's own dates."""
    return F.coalesce(*metric_years, *[year_from_iso(d) for d in period_dates], F.lit(DEFAULT_YEAR))


def search_query(year: Column) -> Column:
    return F.format_string(QUERY_TEMPLATE, year)


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM/yyyy")


def day_label(day: Column) -> Column:
    return F.date_format(day, "dd/MM")
