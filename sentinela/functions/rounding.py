"""Rounding that agrees with IEEE round-half-even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact_sql(value: str, digits: int) -> str:
    """`round_exact` as SQL text."""
    half = 5 / 10 ** (digits + 1)
    return (
        f"(CASE WHEN abs({value}) = {half!r}D THEN signum({value}) * {round(half, digits)!r}D "
        f"ELSE CAST(replace(format_number({value}, {digits}), ',', '') AS DOUBLE) END + 0.0D)"
    )


def round_exact(value: Column, digits: int) -> Column:
    """Nearest decimal of `digits` places to the exact binary value; exact ties go to even.

    `round` and `bround` work on the shortest decimal spelling, which differs on values such as 2.675
    (stored as 2.67499…). `format_number` formats the exact value, so 2.675 gives 2.67 and 0.03125 gives
    0.0312. Its formatter loses one value, half a unit of the last place, which is therefore set apart.
    Adding 0.0 turns a negative zero into zero.
    """
    half = 5 / 10 ** (digits + 1)
    formatted = F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")
    return F.when(F.abs(value) == half, F.signum(value) * round(half, digits)).otherwise(formatted) + F.lit(0.0)
