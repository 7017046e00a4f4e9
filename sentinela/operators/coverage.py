"""Vaccination coverage of the population, with the hospital-based rates where no population is known.

The population table says how many people a state has and how many of them are fully vaccinated, each row from a day on and
until another. What holds on a day is found by an as-of join: the table's rows and the rows that ask are put in one order of
time per state, and each row that asks takes the last one before it. So the work is one sort, whatever the number of intervals,
and no row meets all intervals of its state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.functions.rounding import round_exact_sql
from sentinela.schema import RATE_DIGITS

POPULATION, HOSPITAL = "population", "hospital"
VACCINE = "vaccination_coverage"


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, start: str, end: str | None = None) -> DataFrame:
    """`left` with the columns of the last row of `right` that starts on or before `at`, per group; NULL where there is none, or
    where that row ends on or before `at`.

    Of rows that start together the last by all their values counts. Groups that are NULL match like any other; rows without
    `at` match nothing. The columns of `right` but `by` must not be those of `left`.
    """
    found = [c for c in right.columns if c not in by]
    ask = left.select(*by, F.col(at).alias("_time"), F.lit(1).alias("_asks"), F.struct(*left.columns).alias("_row"))
    tell = right.filter(F.col(start).isNotNull()).select(*by, F.col(start).alias("_time"), F.lit(0).alias("_asks"), F.struct(*found).alias("_told"))
    both = ask.unionByName(tell, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(F.col("_time").asc_nulls_first(), "_asks", F.col("_told").asc_nulls_first())
    told = F.last("_told", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = both.withColumn("_last", told).filter("_asks = 1")
    held = F.col("_time").isNotNull()
    if end:
        held &= F.col(f"_last.{end}").isNull() | (F.col(f"_last.{end}") > F.col("_time"))
    return joined.select("_row.*", *[F.when(held, F.col(f"_last.{c}")).alias(c) for c in found])


def population_coverage(metrics: DataFrame, population: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """The vaccination rows of `metrics` (by, `at`, the long metric rows) with the coverage of the population where it is known.

    `population` is (by, valid_from, valid_to, people, covid, flu), valid_to NULL while it holds. A row gets value, numerator
    and denominator from what holds on its day `at`, and `basis` population; where nothing holds, or nobody lives, it stays
    as it is, with `basis` hospital. The two vaccines are never put together.
    """
    rows = metrics.filter(F.col("metric_key") == VACCINE)
    told = as_of_join(rows, population, by, at, "valid_from", "valid_to")
    vaccinated = F.when(F.col("component") == "covid", F.col("covid")).otherwise(F.col("flu"))
    known = (F.col("people") > 0) & vaccinated.isNotNull()
    told = told.withColumns({"_n": F.when(known, vaccinated).cast("bigint"), "_d": F.when(known, F.col("people")).cast("bigint")})
    value = F.expr(f"CASE WHEN _d > 0 THEN {round_exact_sql('_n / nullif(_d, 0)', RATE_DIGITS)} END")
    kept = {
        "value": F.coalesce(value, "value"), "computable": F.col("_d").isNotNull() | F.col("computable"),
        "numerator": F.coalesce("_n", "numerator"), "denominator": F.coalesce("_d", "denominator"),
    }
    basis = F.when(F.col("_d").isNotNull(), POPULATION).otherwise(HOSPITAL)
    return told.select(*[kept.get(c, F.col(c)).alias(c) for c in rows.columns], basis.alias("basis"))
