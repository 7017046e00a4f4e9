"""Metric values and metric lines as text, from a row of wide facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela.operators.facts import slot
from sentinela.schema import METRIC_KEYS, METRICS

# Fixed value: shown for a metric that could not be computed.
NO_DATA = "Dados insuficientes para cálculo neste período"


def _parts(metric_key: str) -> list[tuple[str, Column]]:
    return [(c, F.col(slot(metric_key, c))) for c in METRICS[metric_key]["components"]]


def short_decimal(value: Column) -> Column:
    """A value of at most four decimals without padding: 0.625, 0.5, 1.0."""
    return F.regexp_replace(F.format_string("%.4f", value), r"0{1,3}\z", "")


def value_text(metric_key: str) -> Column:
    """Four decimals; a metric in parts as `covid: 0.625; flu: 0.5`."""
    parts = _parts(metric_key)
    if len(parts) == 1:
        return F.format_string("%.4f", parts[0][1]["value"])
    return F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), short_decimal(fact["value"])) for c, fact in parts])


def numerator_text(metric_key: str) -> Column:
    """The count; a metric in parts as `{'covid': 5, 'flu': 4}`."""
    parts = _parts(metric_key)
    if len(parts) == 1:
        return parts[0][1]["numerator"].cast("string")
    inner = [F.concat(F.lit(f"'{c}': "), fact["numerator"].cast("string")) for c, fact in parts]
    return F.concat(F.lit("{"), F.concat_ws(", ", *inner), F.lit("}"))


def table_row(metric_key: str) -> Column:
    """Row of the metric table; NULL where the report lacks the metric."""
    name, caveat = METRICS[metric_key]["name"], METRICS[metric_key]["caveat"]
    fact = _parts(metric_key)[0][1]
    known = F.concat(F.lit(f"| {name} | "), value_text(metric_key), F.lit(" | "), fact["period"], F.lit(f" ({caveat}) |"))
    return F.when(fact["computable"], known).when(fact.isNotNull(), F.lit(f"| {name} | {NO_DATA} | — |"))


def prompt_lines(metric_key: str) -> Column:
    """Lines describing one metric to the model; NULL where the report lacks the metric."""
    meta = METRICS[metric_key]
    fact = _parts(metric_key)[0][1]
    known = F.concat(
        F.lit(f"- {meta['name']}: "), value_text(metric_key), F.lit("\n  Período: "), fact["period"],
        F.lit("\n  Numerador: "), numerator_text(metric_key), F.lit(" | Denominador: "), fact["denominator"].cast("string"),
        F.lit(f"\n  Definição: {meta['definition']}\n  Observação: {meta['caveat']}\n"),
    )
    unknown = F.lit(f"- {meta['name']}: {NO_DATA}.\n  Definição: {meta['definition']}\n")
    return F.when(fact["computable"], known).when(fact.isNotNull(), unknown)


def metric_lines(line) -> list[Column]:
    return [line(k) for k in METRIC_KEYS]
