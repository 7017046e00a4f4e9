"""Numbers and values that agree within a tolerance, for numbers without a report.

A number states a value if it differs from it by `tolerance` of the value at most, or by ZERO from a value of zero. Values are
put into buckets of their logarithm, as wide as the tolerance, so that a number's values lie in its own bucket or one next to
it: values are looked up by equality, three buckets each, and no number meets a value that is far from it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.01
ZERO = 0.01


def states(number: Column, value: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(value == 0, F.abs(number) <= ZERO).otherwise(F.abs(number - value) <= tolerance * F.abs(value))


def bucket(value: Column, tolerance: float = TOLERANCE) -> Column:
    """Number of the bucket of a value other than zero, whatever its sign; the width has a little to spare for rounding."""
    return F.floor(F.log(F.abs(value)) / F.lit(-math.log1p(-tolerance) * (1 + 1e-9))).cast("bigint")


def tolerance_join(numbers: DataFrame, values: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(number, value): every distinct `number` of `numbers` with every distinct `value` of `values` that it states.

    Both sides are made distinct first, so that a number that half of all texts state is looked up once. Missing and infinite
    ones state nothing.
    """
    def plain(df: DataFrame, name: str) -> DataFrame:
        # adding zero makes one of both zeros
        return df.select((F.col(name).cast("double") + F.lit(0.0)).alias(name)).filter(F.col(name).isNotNull() & (F.abs(F.col(name)) < float("inf"))).distinct()

    sign = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
    key = F.struct(sign("number").alias("sign"), F.when(F.col("number") != 0, bucket(F.col("number"), tolerance)).alias("at"))
    near_zero = F.when(F.abs("number") <= ZERO, F.struct(F.lit(0).alias("sign"), F.lit(0).cast("bigint").alias("at")))
    asked = plain(numbers, "number").select("number", F.explode(F.array_compact(F.array(F.when(F.col("number") != 0, key), near_zero))).alias("k"))
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda n: F.struct(sign("value").alias("sign"), (bucket(F.col("value"), tolerance) + n).alias("at")))
    zero = F.array(F.struct(F.lit(0).alias("sign"), F.lit(0).cast("bigint").alias("at")))
    told = plain(values, "value").select("value", F.explode(F.when(F.col("value") == 0, zero).otherwise(around)).alias("k"))
    return asked.join(told, "k").filter(states(F.col("number"), F.col("value"), tolerance)).select("number", "value")


def stated_metrics(numbers: DataFrame, metrics: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(number, metric_key, component, reports, nearest): which metrics, of how many reports, each distinct number may state, and
    the value nearest to it, of equally near ones the smaller. `metrics` are long metric rows with `report_id`."""
    known = metrics.filter("computable").groupBy("metric_key", "component", F.col("value").alias("value")).agg(F.countDistinct("report_id").alias("n"))
    pairs = tolerance_join(numbers, known)
    found = pairs.join(known, "value")
    gap = F.struct(F.abs(F.col("number") - F.col("value")).alias("gap"), F.col("value"))
    return found.groupBy("number", "metric_key", "component").agg(F.sum("n").alias("reports"), F.min(gap)["value"].alias("nearest"))
