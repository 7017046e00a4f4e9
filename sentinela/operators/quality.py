"""Personal-data and column provenance of a case table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.schema import PII_COLUMNS, SELECTED_COLUMNS

REPORT_SCHEMA = "section string, position int, name string, status string"


def pii_report(raw: DataFrame) -> DataFrame:
    """(position, column, status) of the fourteen personal-data columns, from the schema alone."""
    rows = [
        (i, c, "present_and_stripped" if c in raw.columns else "already_absent") for i, c in enumerate(PII_COLUMNS)
    ]
    return raw.sparkSession.createDataFrame(rows, "position int, column string, status string")


def drop_pii(raw: DataFrame) -> DataFrame:
    return raw.drop(*[c for c in PII_COLUMNS if c in raw.columns])


def select_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The known columns present, in list order, and the names of those that are missing."""
    missing = [c for c in SELECTED_COLUMNS if c not in df.columns]
    return df.select(*[c for c in SELECTED_COLUMNS if c in df.columns]), missing


def exclusion_log(raw: DataFrame, encoding: str | None = None) -> DataFrame:
    """What loading does to a table: (section, position, name, status).

    Sections are `input` and `output` (columns, with the row count as the status of the row called `rows`, and the encoding
    that the input was read with, if it is given, as that of `encoding`),
    `pii_columns`, and `columns_not_found` only if any are missing. Cleaning keeps every row, so one count
    serves both ends.
    """
    kept, missing = select_columns(drop_pii(raw))
    rows = [("input", i + 1, c, "read") for i, c in enumerate(raw.columns)]
    rows += [
        ("pii_columns", i, c, "present_and_stripped" if c in raw.columns else "already_absent")
        for i, c in enumerate(PII_COLUMNS)
    ]
    rows += [("input", 0, "encoding", encoding)] if encoding else []
    rows += [("columns_not_found", i, c, "missing") for i, c in enumerate(missing)]
    rows += [("output", i + 1, c, "kept") for i, c in enumerate(kept.columns)]
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(0).alias("position"), F.lit("rows").alias("name"))
                         for s in ("input", "output")])
    counted = raw.agg(F.count(F.lit(1)).cast("string").alias("status")).select(F.inline(sections), "status")
    return counted.unionByName(raw.sparkSession.createDataFrame(rows, REPORT_SCHEMA))
