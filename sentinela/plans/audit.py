"""One audit record per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.operators.facts import slot, wide_facts
from sentinela.operators.metrics import METRIC_SQL
from sentinela.plans.sinks import read_latest, write_batch
from sentinela.schema import METRICS, definition_ref


def _audited(metric_key: str) -> Column:
    """The seven audited fields of a metric; one in parts has a value and a numerator per part, one that failed no query."""
    components = METRICS[metric_key]["components"]
    facts = {c: F.col(slot(metric_key, c)) for c in components}
    first = facts[components[0]]

    def field(name: str) -> Column:
        if components == [""]:
            return first[name]
        return F.struct(*[facts[c][name].alias(c) for c in components])

    return F.when(
        first.isNotNull(),
        F.struct(
            field("value").alias("value"),
            F.coalesce(first["computable"], F.lit(False)).alias("computable"),
            field("numerator").alias("numerator"),
            first["denominator"].alias("denominator"),
            F.coalesce(first["period"], F.lit("")).alias("period"),
            F.lit(definition_ref(metric_key)).alias("definition_ref"),
            F.when(first["failed"], "").otherwise(" ".join(METRIC_SQL[metric_key].split())).alias("query"),
        ),
    )


def audit_records(runs: DataFrame, metrics: DataFrame, outcomes: DataFrame, news_flags: DataFrame) -> DataFrame:
    """The audit record of every run, whether or not it reached a narrative.

    `runs` is (report_id, run_id, generated_at, data_mode, data_check_result, source_csv_hash,
    source_extraction_date, exclusion_log, chart_paths, news_source, error); `outcomes` carries the draft of
    each run as `narrative` next to its outcome; `news_flags` is (report_id, news_flagged).
    """
    joined = (
        runs.join(wide_facts(metrics), "report_id", "left")
        .join(news_flags.select("report_id", "news_flagged"), "report_id", "left")
        .join(outcomes.drop("report_id"), "run_id", "left")
    )
    return joined.select(
        F.coalesce("run_id", F.lit("unknown")).alias("run_id"),
        F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        "data_mode", "data_check_result", "source_csv_hash", "source_extraction_date", "exclusion_log",
        F.struct(*[_audited(k).alias(k) for k in METRICS]).alias("metrics"),
        "chart_paths", "news_source",
        F.coalesce("news_flagged", F.lit(False)).alias("news_flagged"),
        F.coalesce("narrative", F.lit("")).alias("narrative_draft"),
        "validation_diff",
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.coalesce("validation_passed", F.lit(False)).alias("validation_passed"),
        "error",
    )


def write_audit(records: DataFrame, path: str, batch: str | None = None) -> str:
    """Store the records as JSON lines; the same runs written again replace their records. See `sinks.write_batch`."""
    return write_batch(records, path, "json", batch)


def read_audit(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record per run, its latest by timestamp. Without a schema, one pass over the files finds it."""
    return read_latest(spark, path, "json", ["timestamp"], schema=schema)
