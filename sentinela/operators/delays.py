"""Notification delays: the reporting triangle, how complete each onset day is by now, and growth corrected for it.

The last one to two weeks of any line list lack cases that are not notified yet. A triangle counts cases by onset day and delay
to notification, in days. As of some day, an onset day `age` days ago shows delays up to `age` only. The share of a day's
cases that are known within a delay comes from cumulative ratios: of the cases known after k days, how many were known after
k - 1, taken over the onset days old enough to tell; the product of these ratios from a delay to the longest is the share.

Each cell of a triangle enters the sums of ratio k for every k from its delay to its day's age. Counted as one step up at
the delay and one down after the age, all ratios come from running sums over at most `max_delay` + 1 steps per group: one
aggregation of the cases, whatever their number, and nothing else that grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.functions.rounding import round_exact_sql
from sentinela.schema import GROWTH_DAYS, GROWTH_DIGITS, ONSET

NOTIFIED = "DT_NOTIFIC"
MAX_DELAY = 60
SHARE_DIGITS = 6


def reporting_triangle(cases: DataFrame, by: Sequence[str] = (), onset: str = ONSET, notified: str = NOTIFIED) -> DataFrame:
    """(by, onset, delay, cases): the cells of the triangle. Cases without one of the dates, or notified before their onset,
    are in no cell; `unusable_dates` counts them."""
    delay = F.datediff(notified, onset)
    return cases.filter(delay >= 0).groupBy(*by, F.col(onset).alias("onset"), delay.alias("delay")).agg(F.count(F.lit(1)).alias("cases"))


def unusable_dates(cases: DataFrame, by: Sequence[str] = (), onset: str = ONSET, notified: str = NOTIFIED) -> DataFrame:
    """(by, missing, reversed): cases that no triangle counts, and why."""
    delay = F.datediff(notified, onset)
    return cases.groupBy(*by).agg(F.count_if(delay.isNull()).alias("missing"), F.count_if(delay < 0).alias("reversed"))


def known_cells(triangle: DataFrame, as_of: str, max_delay: int = MAX_DELAY) -> DataFrame:
    """The cells that are known on `as_of`, with the onset day's age; longer delays than `max_delay` count as that."""
    age = F.datediff(F.lit(as_of).cast("date"), "onset")
    known = triangle.withColumn("age", age).filter(F.col("age") >= F.col("delay"))
    return known.withColumn("delay", F.least("delay", F.lit(max_delay)))


def delay_ratios(triangle: DataFrame, as_of: str, by: Sequence[str] = (), max_delay: int = MAX_DELAY) -> DataFrame:
    """(by, delay, within, before): for each delay from 1 on, the cases known within it and those known a day sooner, of the
    onset days that are that old on `as_of`. Delays at which nothing changes have no row; their ratio is 1."""
    cells = known_cells(triangle, as_of, max_delay)
    steps = F.inline(F.array(
        F.struct(F.col("delay").alias("step"), F.col("cases").alias("arrived"), F.lit(0).cast("bigint").alias("left")),
        F.struct((F.col("age") + 1).alias("step"), F.lit(0).cast("bigint").alias("arrived"), F.col("cases").alias("left"))))
    steps = cells.select(*by, "delay", "age", "cases").select(*by, steps).filter(F.col("step") <= max_delay)
    steps = steps.groupBy(*by, "step").agg(F.sum("arrived").alias("arrived"), F.sum("left").alias("left"))
    run = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum(F.col("arrived") - F.col("left")).over(run)
    return steps.select(*by, F.col("step").alias("delay"), within.alias("within"), (within - F.col("arrived")).alias("before")).filter("delay > 0")


def completion_shares(triangle: DataFrame, as_of: str, by: Sequence[str] = (), max_delay: int = MAX_DELAY) -> DataFrame:
    """(by, shares): per group the share of cases known within 0, 1, … `max_delay` days, as an array.

    Delays that no onset day is old enough to tell of count as complete. A ratio of 0 (nothing was known sooner) ends the
    product: shares below it are 0, which means that nothing can be said.
    """
    ratios = delay_ratios(triangle, as_of, by, max_delay).filter("within > 0")
    listed = ratios.groupBy(*by).agg(F.collect_list(F.struct("delay", "within", "before")).alias("r"))
    ratio = lambda k: F.get(F.transform(F.filter("r", lambda x: x["delay"] == k), lambda x: x["before"] / x["within"]), F.lit(0))
    # from the longest delay down, so that every share is a product in one fixed order
    factors = F.transform(F.sequence(F.lit(max_delay), F.lit(1), F.lit(-1)), lambda k: F.coalesce(ratio(k), F.lit(1.0)))
    return listed.select(*by, F.aggregate(factors, F.array(F.lit(1.0)), lambda a, x: F.array_prepend(a, a[0] * x)).alias("shares"))


def completed_days(triangle: DataFrame, as_of: str, by: Sequence[str] = (), max_delay: int = MAX_DELAY) -> DataFrame:
    """(by, onset, reported, age, share, expected): every onset day with cases known on `as_of`, and how many are to be expected
    once all are notified: reported / share. expected is NULL where the share is 0."""
    shares = completion_shares(triangle, as_of, by, max_delay)
    days = known_cells(triangle, as_of, max_delay).groupBy(*by, "onset", "age").agg(F.sum("cases").alias("reported"))
    at = F.least("age", F.lit(max_delay))
    if by:  # one row of max_delay + 1 shares per group
        same = reduce(and_, [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by])
        joined = days.alias("d").join(shares.alias("s"), same, "left").select("d.*", F.get("s.shares", at).alias("share"))
    else:
        joined = days.withColumn("share", F.get(shares.select("shares").scalar(), at))
    share = F.round(F.coalesce("share", F.lit(1.0)), SHARE_DIGITS)
    return joined.select(*by, "onset", "reported", "age", share.alias("share")).withColumn(
        "expected", F.round(F.col("reported") / F.when(F.col("share") > 0, F.col("share")), 3))


def completed_growth(
    triangle: DataFrame, as_of: str, by: Sequence[str] = (), days: int = GROWTH_DAYS, max_delay: int = MAX_DELAY
) -> DataFrame:
    """(by, current, prior, value, expected_current, expected_prior, expected_value): case growth over the `days` before `as_of`
    against those before them, as reported and as to be expected. A rate is NULL where its prior count is 0, and the
    expected counts leave out days whose share is 0."""
    age = F.col("age")
    now, then = age.between(1, days), age.between(days + 1, 2 * days)
    counted = completed_days(triangle, as_of, by, max_delay).filter(age.between(1, 2 * days)).groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(n) for n, when, c in (
            ("current", now, "reported"), ("prior", then, "reported"))],
        *[F.round(F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0)), 3).alias(n) for n, when, c in (
            ("expected_current", now, "expected"), ("expected_prior", then, "expected"))])
    rate = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN {round_exact_sql(f'({a} - {b}) / nullif({b}, 0) * 100', GROWTH_DIGITS)} END")
    return counted.select(
        *by, "current", "prior", rate("current", "prior").alias("value"), "expected_current", "expected_prior",
        F.round((F.col("expected_current") - F.col("expected_prior")) / F.when(F.col("expected_prior") > 0, F.col("expected_prior")) * 100, 2).alias("expected_value"))
