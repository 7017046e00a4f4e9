"""Values as files deliver them: spellings of missing ones, and codes written as whole decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]


def present(value: Column) -> Column:
    """A raw value, NULL where it spells a missing one."""
    return F.when(~value.isin(MISSING), value)


def is_whole(value: Column) -> Column:
    number = value.try_cast("double")
    return number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 2**31)
