"""Prompts and reports, one row per report, from tables keyed by report.

Every input is reduced to one small row per report before it is joined, so the joins are equality joins of
tables already hashed by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.functions.dates import day_label, month_label
from sentinela.functions.display import metric_lines, prompt_lines, table_row
from sentinela.operators.facts import wide_facts
from sentinela.operators.metrics import day_counts
from sentinela.plans.sinks import read_latest, write_batch
from sentinela.schema import DAILY_WINDOW_DAYS, MONTHLY_WINDOW_DAYS

# Texts of the report and the prompt.
TITLE = "# Relatório de Vigilância SRAG\n"
TABLE_HEAD = "## Métricas\n\n| Métrica | Valor | Período |\n|---|---|---|\n"
NARRATIVE_NOTICE = (
    "\n> ⚠️ Esta narrativa foi parcialmente validada — consulte a tabela de métricas oficiais para valores precisos.\n"
)
NO_SOURCES = "## Fontes\n\nNenhuma notícia relevante encontrada neste período.\n"
PROMPT_HEAD = "## Métricas do Período"
PROMPT_NO_NEWS = (
    "## Contexto de Notícias\nNenhuma notícia relevante encontrada neste período. "
    "Não faça afirmações baseadas em notícias."
)
PROMPT_END = (
    "\n## Instrução Final\nCom base nas métricas e notícias acima (quando disponíveis), "
    "gere um parágrafo analítico em português brasileiro descrevendo o cenário epidemiológico de SRAG no período."
)
METHOD_HEAD = "## Metodologia e Limitações\n\n- **Fonte dos dados**: Open DATASUS / SIVEP-Gripe"
METHOD_NO_NEWS = (
    "\n### Notícias\nNão foi possível obter notícias neste período. "
    "A análise baseia-se exclusivamente nas métricas disponíveis."
)
METHOD_VACCINES = (
    "\n### Vacinação\nAs taxas de vacinação reportadas referem-se à proporção de casos hospitalizados com esquema "
    "vacinal completo (VACINA_COV e VACINA). Não representam cobertura populacional.\n"
)


def metric_tables(metrics: DataFrame) -> DataFrame:
    """(report_id, metric_table): the table section, rows in registry order."""
    rows = F.concat_ws("\n", *metric_lines(table_row))
    return wide_facts(metrics).select("report_id", F.concat(F.lit(TABLE_HEAD), rows, F.lit("\n")).alias("metric_table"))


def metric_prompts(metrics: DataFrame) -> DataFrame:
    """(report_id, metric_prompt): the metrics described to the model."""
    parts = F.concat_ws("\n\n", F.lit(PROMPT_HEAD), *metric_lines(prompt_lines))
    return wide_facts(metrics).select("report_id", parts.alias("metric_prompt"))


def prompts(metrics: DataFrame, blocks: DataFrame, availability: DataFrame) -> DataFrame:
    """(report_id, prompt) from metric rows, sanitised blocks and news availability, for every report of any of them."""
    joined = metric_prompts(metrics).join(blocks, "report_id", "full").join(availability, "report_id", "full")
    with_news = (F.col("news_source") == "tavily") & (F.col("sanitized_news") != "")
    news = F.when(with_news, F.concat(F.lit("## Contexto de Notícias\n\n"), F.col("sanitized_news"))).otherwise(PROMPT_NO_NEWS)
    described = F.coalesce("metric_prompt", F.lit(PROMPT_HEAD))
    return joined.select("report_id", F.concat_ws("\n\n", described, news, F.lit(PROMPT_END)).alias("prompt"))


def source_lists(news: DataFrame) -> DataFrame:
    """(report_id, sources): the report's items, numbered."""
    items = news.groupBy("report_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "title", "source", "url"))).alias("items")
    )
    lines = F.transform(
        "items",
        lambda n, i: F.concat((i + 1).cast("string"), F.lit(". **"), n["title"], F.lit("** — "), n["source"], F.lit(" ("), n["url"], F.lit(")")),
    )
    return items.select(
        "report_id", F.concat(F.lit("## Fontes e Referências\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("sources")
    )


def methodology(
    extraction_date: Column, csv_hash: Column, stripped: Column, missing: Column, news_source: Column
) -> Column:
    """The method section. `stripped` and `missing` are arrays of column names; NULL `missing` means none looked for."""
    return F.concat_ws(
        "\n",
        F.lit(METHOD_HEAD),
        F.concat(F.lit("- **Data de extração**: "), extraction_date),
        F.concat(F.lit("- **Hash do arquivo**: `"), F.left(csv_hash, F.lit(16)), F.lit("...`")),
        F.lit("\n### Exclusões aplicadas"),
        F.when(F.size(stripped) > 0, F.concat(F.lit("- Colunas com dados sensíveis removidas: "), F.array_join(stripped, ", "))),
        F.when(missing.isNotNull(), F.concat(F.lit("- Colunas esperadas não encontradas: "), F.array_join(missing, ", "))),
        F.when(news_source == "unavailable", F.lit(METHOD_NO_NEWS)),
        F.lit(METHOD_VACCINES),
    )


def narrative_section(narrative: Column, passed: Column) -> Column:
    return F.concat(
        F.lit("## Análise\n\n"), narrative, F.lit("\n"), F.when(passed, F.lit("")).otherwise(NARRATIVE_NOTICE)
    )


def series_by_end(cases: DataFrame, ends: DataFrame) -> DataFrame:
    """Daily and monthly series up to each distinct `end_date`: (end_date, kind, bucket, label, casos).

    The cases are counted per day once. Each end date is expanded to the days it looks back on and joined to
    the counts on the day.
    """
    end = F.col("end_date").try_cast("date")
    distinct = ends.select("end_date").distinct()
    days = distinct.select(
        "end_date", end.alias("e"), F.explode(F.sequence(F.date_sub(end, MONTHLY_WINDOW_DAYS), F.date_sub(end, 1))).alias("day")
    )
    counted = days.join(day_counts(cases).select("day", "cases"), "day")
    daily = F.when(F.col("day") >= F.date_sub("e", DAILY_WINDOW_DAYS), F.struct(F.lit("daily").alias("kind"), F.col("day").alias("bucket")))
    monthly = F.struct(F.lit("monthly").alias("kind"), F.trunc("day", "month").alias("bucket"))
    both = counted.select("end_date", "cases", F.explode(F.array_compact(F.array(daily, monthly))).alias("b"))
    summed = both.groupBy("end_date", "b.kind", "b.bucket").agg(F.sum("cases").alias("casos"))
    label = F.when(F.col("kind") == "daily", day_label(F.col("bucket"))).otherwise(month_label(F.col("bucket")))
    return summed.select("end_date", "kind", "bucket", label.alias("label"), "casos")


def series_sections(series: DataFrame) -> DataFrame:
    """(end_date, charts): both series as tables; at most 30 daily and 13 monthly rows each."""
    points = series.groupBy("end_date").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("bucket", "label", "casos")))).alias(k)
            for k in ("daily", "monthly")
        ]
    )

    def lines(kind: str) -> Column:
        rows = F.transform(kind, lambda p: F.concat(F.lit("| "), p["label"], F.lit(" | "), p["casos"].cast("string"), F.lit(" |")))
        return F.when(F.size(kind) > 0, F.concat(F.lit("| Período | Casos |\n|---|---|\n"), F.array_join(rows, "\n"), F.lit("\n"))).otherwise("No data\n")

    return points.select(
        "end_date",
        F.concat(
            F.lit("## Gráficos\n\n### Número diário de casos — últimos 30 dias\n\n"), lines("daily"),
            F.lit("\n### Número mensal de casos — últimos 12 meses\n\n"), lines("monthly"),
        ).alias("charts"),
    )


NO_CHARTS = (
    "## Gráficos\n\n### Número diário de casos — últimos 30 dias\n\nNo data\n"
    "\n### Número mensal de casos — últimos 12 meses\n\nNo data\n"
)


def render_reports(
    runs: DataFrame, metrics: DataFrame, outcomes: DataFrame, news: DataFrame, series: DataFrame
) -> DataFrame:
    """(report_id, run_id, report): the whole report text of each run.

    `runs` is (report_id, run_id, generated_at, end_date, source_csv_hash, source_extraction_date,
    pii_stripped, columns_not_found, news_source); `outcomes` has the validated narrative of each run; `news`
    holds the items of the reports; `series` that of `series_by_end`.
    """
    # what does not depend on the run, once per report and end date
    sections = (
        runs.select("report_id", "end_date").distinct()
        .join(metric_tables(metrics), "report_id", "left")
        .join(source_lists(news), "report_id", "left")
        .join(series_sections(series), "end_date", "left")
    )
    of_report = sections.withColumnsRenamed({"report_id": "_report_id", "end_date": "_end_date"})
    joined = runs.join(outcomes.select("run_id", "narrative_validated", "validation_passed"), "run_id", "left").join(
        of_report, F.col("report_id").eqNullSafe(F.col("_report_id")) & F.col("end_date").eqNullSafe(F.col("_end_date")), "left"
    )
    footer = F.concat(
        F.lit("---\n*Relatório gerado em: "), F.date_format("generated_at", "dd/MM/yyyy HH:mm:ss"),
        F.lit(" — run_id: `"), F.col("run_id"), F.lit("`*\n"),
    )
    report = F.concat_ws(
        "\n",
        F.lit(TITLE),
        F.coalesce("metric_table", F.lit(TABLE_HEAD)),
        narrative_section(F.coalesce("narrative_validated", F.lit("")), F.coalesce("validation_passed", F.lit(False))),
        F.coalesce("charts", F.lit(NO_CHARTS)),
        F.coalesce("sources", F.lit(NO_SOURCES)),
        methodology(
            F.col("source_extraction_date"), F.col("source_csv_hash"), F.col("pii_stripped"),
            F.col("columns_not_found"), F.col("news_source"),
        ),
        footer,
    )
    return joined.select("report_id", "run_id", report.alias("report"))


def write_reports(reports: DataFrame, path: str, batch: str | None = None) -> str:
    """Reports as rows of a Parquet table, a file per report would be millions of small files; the same runs written again
    replace their reports. See `sinks.write_batch`."""
    return write_batch(reports.withColumn("written_at", F.current_timestamp()), path, "parquet", batch)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One report per run, the one written last."""
    return read_latest(spark, path, "parquet", ["written_at"])
