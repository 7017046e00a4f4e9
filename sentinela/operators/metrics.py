"""Epidemiological metrics: one aggregation pass for a period, two small shuffles for many periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import add

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.functions.dates import ordered_period, period_text
from sentinela.functions.raw import is_whole, present
from sentinela.functions.rounding import round_exact_sql
from sentinela.operators.skew import MIN_ROWS, PART, hot_keys, repeat_hot, split_hot
from sentinela.schema import (
    GROWTH_DAYS,
    GROWTH_DIGITS,
    METRIC_KEYS,
    METRICS,
    ONSET,
    RATE_DIGITS,
    definition_ref,
)

# Every count that any metric needs, as a condition on one case. NULL codes are not counted. The ICU count
# is over all cases, not only hospitalised ones; the vaccination counts are over hospitalised cases.
COUNTS = {
    "deaths": "EVOLUCAO = 2",
    "resolved": "EVOLUCAO IN (1, 2)",
    "uti": "UTI = 1",
    "hospital": "HOSPITAL = 1",
    "covid": "HOSPITAL = 1 AND VACINA_COV = 1",
    "flu": "HOSPITAL = 1 AND VACINA = 1",
}
COUNT_COLUMNS = {
    "deaths": ["EVOLUCAO"], "resolved": ["EVOLUCAO"], "uti": ["UTI"], "hospital": ["HOSPITAL"],
    "covid": ["HOSPITAL", "VACINA_COV"], "flu": ["HOSPITAL", "VACINA"],
}

# (metric, component) -> (numerator, denominator) among the counts.
RATIOS = {
    ("case_growth_rate", ""): ("current", "prior"),
    ("mortality_rate", ""): ("deaths", "resolved"),
    ("uti_admission_rate", ""): ("uti", "hospital"),
    ("vaccination_coverage", "covid"): ("covid", "hospital"),
    ("vaccination_coverage", "flu"): ("flu", "hospital"),
}

# The statement that defines each metric, with bound parameters; carried in the audit record.
METRIC_SQL = {
    "case_growth_rate": f"""
        SELECT count_if({ONSET} >= date_sub(CAST(:end AS DATE), :days) AND {ONSET} < CAST(:end AS DATE)) AS current,
               count_if({ONSET} >= date_sub(CAST(:end AS DATE), 2 * :days)
                        AND {ONSET} < date_sub(CAST(:end AS DATE), :days)) AS prior
        FROM srag
        WHERE {ONSET} >= date_sub(CAST(:end AS DATE), 2 * :days) AND {ONSET} < CAST(:end AS DATE)""",
    "mortality_rate": f"""
        SELECT count_if({COUNTS["deaths"]}) AS deaths, count_if({COUNTS["resolved"]}) AS resolved
        FROM srag WHERE {ONSET} >= CAST(:start AS DATE) AND {ONSET} < CAST(:end AS DATE)""",
    "uti_admission_rate": f"""
        SELECT count_if({COUNTS["uti"]}) AS uti, count_if({COUNTS["hospital"]}) AS hospital
        FROM srag WHERE {ONSET} >= CAST(:start AS DATE) AND {ONSET} < CAST(:end AS DATE)""",
    "vaccination_coverage": f"""
        SELECT count_if({COUNTS["covid"]}) AS covid, count_if({COUNTS["flu"]}) AS flu,
               count_if({COUNTS["hospital"]}) AS hospital
        FROM srag WHERE HOSPITAL = 1 AND {ONSET} >= CAST(:start AS DATE) AND {ONSET} < CAST(:end AS DATE)""",
}


def _missing(metric_key: str, columns: Sequence[str]) -> bool:
    return any(c not in columns for c in METRICS[metric_key]["needs"])


def _ratio_value(metric_key: str, numerator: str, denominator: str) -> str:
    ratio = f"({numerator}) / nullif({denominator}, 0)"
    if metric_key == "case_growth_rate":
        ratio = f"({numerator} - {denominator}) / nullif({denominator}, 0) * 100"
    digits = GROWTH_DIGITS if metric_key == "case_growth_rate" else RATE_DIGITS
    return f"CASE WHEN {denominator} > 0 THEN {round_exact_sql(ratio, digits)} END"


def to_long(
    counts: DataFrame, keep: Sequence[str], period: Column, growth_period: Column, skip: Sequence[str] = (),
    unreadable: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row of counts per group to one row per metric and component, in registry order.

    Metrics in `skip`, and counts that are NULL, give the fallback row: no value, 0 of 0, `failed`. `unreadable` names, for each
    metric, a count of values that could not be read; it is put out too, and a metric with any falls back.
    """
    rows = []
    for position, ((key, component), pair) in enumerate(RATIOS.items()):
        bad = f"{unreadable[key]} > 0" if unreadable else "false"
        failed = "true" if key in skip else f"({bad} OR {pair[0]} IS NULL)"
        num, den = (f"CASE WHEN {failed} THEN 0L ELSE coalesce({c}, 0L) END" if key not in skip else "0L" for c in pair)
        value = _ratio_value(key, num, den)
        span = "growth_period" if key == "case_growth_rate" else "period"
        rows.append(
            f"named_struct('position', {position}, 'metric_key', '{key}', 'component', '{component}', 'value', {value}, "
            f"'computable', {den} > 0, 'numerator', {num}, 'denominator', {den}, 'period', {span}, "
            f"'definition_ref', '{definition_ref(key)}', 'failed', {failed}"
            + (f", 'unreadable', {unreadable[key]})" if unreadable else ")")
        )
    spanned = counts.withColumns({"period": period, "growth_period": growth_period})
    return spanned.selectExpr(*keep, f"inline(array({', '.join(rows)}))")


def _counted(name: str, columns: Sequence[str], inside: Column | None = None) -> Column:
    """Count of one condition, zero where the table lacks a column it needs."""
    if any(c not in columns for c in COUNT_COLUMNS[name]):
        return F.max(F.lit(0)).cast("long").alias(name)
    condition = F.expr(COUNTS[name])
    return F.count_if(condition if inside is None else inside & condition).alias(name)


def compute_metrics(
    cases: DataFrame, start_date: str, end_date: str, days: int = GROWTH_DAYS, by: Sequence[str] = ()
) -> DataFrame:
    """All metrics of one period `[start, end)`, in registry order, from a single pass over the cases.

    Only the dates that any metric can use are read: the filter is on the bare onset column, so it reaches
    the file scan. Dates given the wrong way round are swapped. A metric whose columns are absent from the
    table gives its fallback row. `by` adds group columns (for instance a region).
    """
    start_date, end_date = min(start_date, end_date), max(start_date, end_date)
    period = F.lit(f"{start_date} to {end_date}")
    skip = [k for k in METRIC_KEYS if _missing(k, cases.columns)]
    try:
        start, end = date.fromisoformat(start_date), date.fromisoformat(end_date)
    except ValueError:
        start = end = None
        growth_period = period
        try:
            growth_end = date.fromisoformat(end_date)
            growth_period = F.lit(f"{growth_end - timedelta(days)} to {growth_end}")
        except ValueError:
            growth_end = None
    else:
        growth_end = end
        growth_period = F.lit(f"{end - timedelta(days)} to {end}")

    onset = F.col(ONSET)
    if ONSET not in cases.columns or (start is None and growth_end is None):
        empty = cases.sparkSession.range(1) if not by else cases.select(*by).distinct()
        return to_long(empty, by, period, growth_period, METRIC_KEYS)
    if start is None:
        skip = [k for k in METRIC_KEYS if k != "case_growth_rate" or k in skip]

    current_from, prior_from = growth_end - timedelta(days), growth_end - timedelta(2 * days)
    first = prior_from if start is None else min(start, prior_from)
    inside = F.lit(False) if start is None else onset >= F.lit(start)
    aggregates = [
        F.count_if(onset >= F.lit(current_from)).alias("current"),
        F.count_if((onset >= F.lit(prior_from)) & (onset < F.lit(current_from))).alias("prior"),
    ]
    aggregates += [_counted(name, cases.columns, inside) for name in COUNTS]
    scope = cases.filter((onset >= F.lit(first)) & (onset < F.lit(growth_end)))
    counts = scope.groupBy(*by).agg(*aggregates)
    return to_long(counts, by, period, growth_period, skip)


AGE_BANDS = {"0-4": 4, "5-19": 19, "20-59": 59, "60+": 200}


def age_band(age: str = "NU_IDADE_N", unit: str = "TP_IDADE") -> Column:
    """Band of an age given as a number and its unit, 1 days, 2 months, 3 years; NULL where it is unknown or over 200 years."""
    years = F.when(F.col(unit) == 3, F.col(age)).when((F.col(unit) == 2) & (F.col(age) >= 0), F.floor(F.col(age) / 12)).when((F.col(unit) == 1) & (F.col(age) >= 0), F.lit(0))
    band = F.when(years < 0, None)
    for name, last in AGE_BANDS.items():
        band = band.when(years <= last, name)
    return band


def metrics_by_level(
    cases: DataFrame, start_date: str, end_date: str, levels: Sequence[Sequence[str]], days: int = GROWTH_DAYS
) -> DataFrame:
    """All metrics of one period at several levels of grouping at once, the whole being the level `()`: (level, every group column,
    the metric rows). `level` names the columns that a row is grouped by; the others are NULL in it, as a group without a value is.

    The cases are read and counted once, by all columns together, and only these counts are grouped again per level. Rates
    come from each level's own counts.
    """
    start, end = sorted((date.fromisoformat(start_date), date.fromisoformat(end_date)))
    onset, columns = F.col(ONSET), list(dict.fromkeys(c for level in levels for c in level))
    current_from, prior_from = end - timedelta(days), end - timedelta(2 * days)
    scope = cases.filter((onset >= F.lit(min(start, prior_from))) & (onset < F.lit(end)))
    finest = scope.groupBy(*columns).agg(
        F.count_if(onset >= F.lit(current_from)).alias("current"),
        F.count_if((onset >= F.lit(prior_from)) & (onset < F.lit(current_from))).alias("prior"),
        *[_counted(name, cases.columns, onset >= F.lit(start)) for name in COUNTS])
    names = ["current", "prior", *COUNTS]
    grouped = finest.groupingSets([[F.col(c) for c in level] for level in levels], *columns).agg(
        *[F.sum(n).alias(n) for n in names], F.grouping_id().alias("_level"))
    # the bits of grouping_id are the columns that a row is not grouped by
    bits = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level): ",".join(level) for level in levels}
    level = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    named = grouped.withColumn("level", level[F.col("_level").cast("int")])
    skip = [k for k in METRIC_KEYS if _missing(k, cases.columns)]
    return to_long(named, ["level", *columns], F.lit(f"{start} to {end}"), F.lit(f"{end - timedelta(days)} to {end}"), skip)


def single_metric(cases: DataFrame, metric_key: str, start_date: str | None, end_date: str, days: int = GROWTH_DAYS) -> DataFrame:
    """One metric through its own defining statement with bound parameters."""
    args = {"end": end_date, "days": days} if metric_key == "case_growth_rate" else {"start": start_date, "end": end_date}
    statement = METRIC_SQL[metric_key].replace("FROM srag", "FROM {srag}")
    counts = cases.sparkSession.sql(statement, args=args, srag=cases)
    start, end = F.lit(start_date), F.lit(end_date)
    growth_period = period_text(F.date_sub(F.lit(end_date).cast("date"), days), end)
    period = growth_period if metric_key == "case_growth_rate" else period_text(start, end)
    for (key, _), pair in RATIOS.items():
        for name in pair:
            if name not in counts.columns:
                counts = counts.withColumn(name, F.lit(0).cast("long"))
    return to_long(counts, (), period, growth_period).filter(F.col("metric_key") == metric_key)


def compute_metrics_isolated(cases: DataFrame, start_date: str, end_date: str) -> DataFrame:
    """`compute_metrics` run at once, so that a cast error in one metric's column costs only that metric.

    The shared pass is tried first. Only if it fails are the metrics run one by one, and those that fail
    give their fallback rows. What comes to the driver is five result rows.
    """
    spark = cases.sparkSession
    try:
        rows = compute_metrics(cases, start_date, end_date).collect()
    except PySparkException:
        rows = []
        for key in METRIC_KEYS:
            alone = cases.select(*[c for c in METRICS[key]["needs"] if c in cases.columns])
            wanted = F.col("metric_key") == key
            try:
                rows += compute_metrics(alone, start_date, end_date).filter(wanted).collect()
            except PySparkException:
                rows += compute_metrics(alone.drop(ONSET), start_date, end_date).filter(wanted).collect()
    return _long_rows(spark, rows)


def isolated_metrics(
    cases: DataFrame, start_date: str, end_date: str, days: int = GROWTH_DAYS, by: Sequence[str] = ()
) -> DataFrame:
    """`compute_metrics` over columns as they were delivered, in one pass in which a value that cannot be read costs only the
    metrics, and with `by` only the groups, whose counts it would enter.

    Columns may be text or typed. Text that is no whole number in a coded column, or no date in the onset column, is counted
    beside the metrics' own counts instead of raising. A coded value counts against the metrics that need its column if its
    case lies in their window; an unreadable onset lies in no window and counts against every metric. Such a metric gives its
    fallback row; `unreadable` says how many values are the reason. Missing values are no errors. No action is run.
    """
    start, end = sorted((date.fromisoformat(start_date), date.fromisoformat(end_date)))
    period, growth_period = F.lit(f"{start} to {end}"), F.lit(f"{end - timedelta(days)} to {end}")
    typed = dict(cases.dtypes)
    needed = [c for c in dict.fromkeys(c for m in METRICS.values() for c in m["needs"]) if c in typed]
    skip = [k for k in METRIC_KEYS if _missing(k, cases.columns)]
    text = [c for c in needed if typed[c] == "string"]
    read = {c: present(F.col(c)) for c in text}
    value = {c: read[c].try_cast("date") if c == ONSET else F.when(is_whole(read[c]), read[c].try_cast("double").cast("int")) for c in text}
    rows = cases.select(
        *by, *[value.get(c, F.col(c)).alias(c) for c in needed if c not in by],
        *[(read[c].isNotNull() & value[c].isNull()).alias(f"_bad_{c}") for c in text])
    if ONSET not in needed:
        empty = cases.sparkSession.range(1) if not by else cases.select(*by).distinct()
        zero = empty.withColumn("_zero", F.lit(0).cast("bigint"))
        return to_long(zero, by, period, growth_period, METRIC_KEYS, dict.fromkeys(METRIC_KEYS, "_zero"))

    onset = F.col(ONSET)
    current_from, prior_from = end - timedelta(days), end - timedelta(2 * days)
    inside = (onset >= F.lit(start)) & (onset < F.lit(end))
    scope = (onset >= F.lit(min(start, prior_from))) & (onset < F.lit(end))
    lost = F.col(f"_bad_{ONSET}") if ONSET in text else F.lit(False)
    aggregates = [
        F.count_if((onset >= F.lit(current_from)) & (onset < F.lit(end))).alias("current"),
        F.count_if((onset >= F.lit(prior_from)) & (onset < F.lit(current_from))).alias("prior"),
        *[_counted(name, rows.columns, inside) for name in COUNTS],
    ]
    for key in METRIC_KEYS:
        bad = [F.col(f"_bad_{c}").cast("int") for c in METRICS[key]["needs"] if c in text and c != ONSET]
        in_window = F.when(inside, reduce(add, bad)) if bad else F.lit(0)
        aggregates.append(F.coalesce(F.sum(F.coalesce(in_window, F.lit(0)) + lost.cast("int")), F.lit(0)).cast("bigint").alias(f"_unreadable_{key}"))
    counts = rows.filter(scope | lost).groupBy(*by).agg(*aggregates)
    return to_long(counts, by, period, growth_period, skip, {k: f"_unreadable_{k}" for k in METRIC_KEYS})


def _long_rows(spark: SparkSession, rows: list) -> DataFrame:
    schema = "position int, metric_key string, component string, value double, computable boolean, " \
        "numerator bigint, denominator bigint, period string, definition_ref string, failed boolean"
    return spark.createDataFrame(rows, schema)


def complete_metrics(metrics: DataFrame, groups: DataFrame, keys: Sequence[str], period: Column) -> DataFrame:
    """Add the fallback row of any registered metric that one of the `groups` lacks.

    `groups` has one row per group; `period` is an expression over its columns. The registry is a handful of
    rows, so every group is expanded to its expected rows and the found ones are joined on.
    """
    expected = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(k).alias("metric_key"), F.lit(c).alias("component"))
        for i, (k, c) in enumerate(RATIOS)
    ])
    wanted = groups.select(*keys, period.alias("_period"), F.inline(expected))
    found = metrics.drop("position")
    joined = wanted.join(found, [*keys, "metric_key", "component"], "left")
    return joined.select(
        *keys, "position", "metric_key", "component", "value",
        F.coalesce("computable", F.lit(False)).alias("computable"),
        F.coalesce("numerator", F.lit(0).cast("long")).alias("numerator"),
        F.coalesce("denominator", F.lit(0).cast("long")).alias("denominator"),
        F.coalesce("period", "_period").alias("period"),
        F.coalesce("definition_ref", F.concat("metric_key", F.lit("_v1"))).alias("definition_ref"),
        F.coalesce(F.col("failed") if "failed" in found.columns else F.col("computable").isNull(), F.lit(True)).alias("failed"),
    )


def day_counts(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All counts per onset day: the cases shrink to at most one row per calendar day (and group).

    The hash aggregate combines on the map side, so a day holding a third of all cases is one row per task.
    """
    aggregates = [F.count(F.lit(1)).alias("cases"), *[_counted(name, cases.columns) for name in COUNTS]]
    return cases.filter(F.col(ONSET).isNotNull()).groupBy(*by, F.col(ONSET).alias("day")).agg(*aggregates)


def running_totals(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(day, names): totals up to and with each calendar day from the first to the last of `counts` (one row per day)."""
    by_day = Window.orderBy("day")
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.select(*[F.sum(n).over(upto).alias(n) for n in names], "day", F.lead("day").over(by_day).alias("next"))
    days = F.sequence(F.col("day"), F.coalesce(F.date_sub("next", 1), F.col("day")))
    return summed.select(F.explode(days).alias("day"), *names)


def metrics_by_period(
    cases: DataFrame, periods: DataFrame, key: str = "report_id", days: int = GROWTH_DAYS, min_rows: int = MIN_ROWS
) -> DataFrame:
    """All metrics for every row of `periods (key, start_date, end_date)`, dates as ISO text.

    The cases are reduced to day counts once, whatever the number of periods, and these to running totals. Each *distinct*
    period looks up four days, whatever its length: an equality join of two small tables. A period that many keys share is
    split over tasks. One with a malformed date, or without cases, keeps its fallback rows.
    """
    start, end = ordered_period(F.col("start_date"), F.col("end_date"))
    periods = periods.select(key, start.alias("start_date"), end.alias("end_date"))
    distinct = periods.select("start_date", "end_date").distinct().select(
        "start_date", "end_date",
        F.col("start_date").try_cast("date").alias("s"), F.col("end_date").try_cast("date").alias("e"),
    ).filter("e IS NOT NULL")
    names = ["cases", *COUNTS]
    by_day = day_counts(cases)
    last = by_day.agg(F.max("day")).scalar()
    looked_up = F.array(*[
        F.struct(F.lit(what).alias("what"), F.least(F.date_sub(day, back), last).alias("day"))
        for what, day, back in (("end", "e", 1), ("start", "s", 1), ("current", "e", days + 1), ("prior", "e", 2 * days + 1))
    ])
    found = distinct.select("start_date", "end_date", "s", F.inline(looked_up)).join(running_totals(by_day, names), "day", "left")
    at = lambda what, name: F.coalesce(F.sum(F.when(F.col("what") == what, F.col(name))), F.lit(0).cast("long"))
    counts = found.groupBy("start_date", "end_date", "s").agg(
        (at("end", "cases") - at("current", "cases")).alias("current"),
        (at("current", "cases") - at("prior", "cases")).alias("prior"),
        *[F.when(F.col("s").isNotNull(), at("end", c) - at("start", c)).alias(c) for c in COUNTS],
    ).drop("s")
    end_day = F.col("end_date").try_cast("date")
    period = period_text(F.col("start_date"), F.col("end_date"))
    growth_period = F.when(end_day.isNotNull(), period_text(F.date_sub(end_day, days), end_day)).otherwise(period)
    hot = hot_keys(periods, ["start_date", "end_date"], min_rows)
    rows = split_hot(periods, hot, ["start_date", "end_date"], key)
    joined = rows.join(repeat_hot(counts, hot, ["start_date", "end_date"]), ["start_date", "end_date", PART], "left")
    skip = [k for k in METRIC_KEYS if _missing(k, cases.columns)]
    return to_long(joined, [key], period, growth_period, skip)


def metric_spec(spark: SparkSession) -> DataFrame:
    """The registry as a table: position, metric_key, name, definition, caveat, definition_ref."""
    rows = [
        (i, k, m["name"], m["definition"], m["caveat"], definition_ref(k)) for i, (k, m) in enumerate(METRICS.items())
    ]
    return spark.createDataFrame(
        rows, "position int, metric_key string, name string, definition string, caveat string, definition_ref string"
    )


def describe_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows with the name, definition and caveat of their metric; the registry is four rows."""
    spec = metric_spec(metrics.sparkSession).drop("position", "definition_ref")
    return metrics.join(F.broadcast(spec), "metric_key", "left")
