"""One row of facts per report, from its metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.operators.metrics import RATIOS


def slot(metric_key: str, component: str) -> str:
    return metric_key if not component else f"{metric_key}_{component}"


SLOTS = {slot(k, c): (k, c) for k, c in RATIOS}


def wide_facts(metrics: DataFrame, key: str = "report_id") -> DataFrame:
    """Metric rows to one row per report: a struct per metric and component, NULL where absent.

    The registry fixes the number of columns, and `max` combines on the map side, so a report repeated a
    million times in the input still is one small row per task.
    """
    part = f"struct(computable, value, numerator, denominator, period, {'failed' if 'failed' in metrics.columns else 'false'} AS failed)"
    return metrics.groupBy(key).agg(*[
        F.expr(f"max(CASE WHEN metric_key = '{k}' AND component = '{c}' THEN {part} END)").alias(name)
        for name, (k, c) in SLOTS.items()
    ])


def allowed_numbers() -> Column:
    """Distinct values a narrative may state, from a row of wide facts.

    Value, numerator and denominator of each computable metric; a proportion also as a percentage.
    """
    numbers = []
    for name in SLOTS:
        for field in ("value", "numerator", "denominator"):
            number = f"CAST({name}.{field} AS DOUBLE)"
            voiced = f"CASE WHEN {number} <> 0 AND abs({number}) < 1 THEN {number} * 100 END"
            numbers += [f"CASE WHEN {name}.computable THEN {n} END" for n in (number, voiced)]
    return F.expr(f"array_distinct(array_compact(array({', '.join(numbers)})))")


def allowed_values(metrics: DataFrame, key: str = "report_id") -> DataFrame:
    """The allowed values as rows (key, value), distinct."""
    return wide_facts(metrics, key).select(key, F.explode(allowed_numbers()).alias("value"))
