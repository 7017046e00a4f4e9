"""Report, prompt and audit texts of a few hand-made reports."""

from datetime import datetime

import pytest

from sentinela.operators.metrics import METRIC_SQL
from sentinela.operators.sanitize import sanitized_blocks
from sentinela.plans import audit, report
from sentinela.sources.news import news_availability

PERIOD = "2026-01-01 to 2026-02-01"
METRICS = "report_id int, metric_key string, component string, value double, computable boolean, numerator bigint, denominator bigint, period string, definition_ref string"


@pytest.fixture(scope="module")
def tables(spark):
    metrics = spark.createDataFrame([
        (1, "case_growth_rate", "", None, False, 5, 0, PERIOD, ""),
        (1, "mortality_rate", "", 0.0005, True, 1, 2000, PERIOD, ""),
        (1, "uti_admission_rate", "", 1.25, True, 5, 4, PERIOD, ""),
        (1, "vaccination_coverage", "covid", 0.0005, True, 5, 8, PERIOD, ""),
        (1, "vaccination_coverage", "flu", 1.0, True, 8, 8, PERIOD, ""),
        (2, "mortality_rate", "", 0.5, True, 1, 2, PERIOD, ""),
    ], METRICS)
    news = spark.createDataFrame([
        (1, 2, "B", "b.br", "https://b.br/2", "dois"), (1, 1, "A", "a.br", "https://a.br/1", "um"),
    ], "report_id int, pos int, title string, source string, url string, snippet string")
    runs = spark.createDataFrame([
        (1, "r-1", datetime(2026, 7, 20, 9, 8, 7), "2026-02-01", "0123456789abcdef0000", "2026-07-20", ["NU_CPF", "NM_PACIENT"], None, "tavily"),
        (2, "r-2", datetime(2026, 7, 20, 9, 8, 7), "2026-02-01", "ff", "unknown", [], ["UTI"], "unavailable"),
    ], "report_id int, run_id string, generated_at timestamp_ntz, end_date string, source_csv_hash string, source_extraction_date string, "
       "pii_stripped array<string>, columns_not_found array<string>, news_source string")
    outcomes = spark.createDataFrame([
        ("r-1", "Texto.", True, 0, "Texto."), ("r-2", "", False, 1, "Rascunho 9"),
    ], "run_id string, narrative_validated string, validation_passed boolean, retry_count int, narrative string")
    outcomes = outcomes.selectExpr("*", "named_struct('numeric_mismatches', array(named_struct('raw', '9', 'value', 9.0D))) AS validation_diff")
    series = spark.createDataFrame([
        ("2026-02-01", "daily", "2026-01-30", "30/01", 4), ("2026-02-01", "daily", "2026-01-02", "02/01", 3),
        ("2026-02-01", "monthly", "2026-01-01", "Jan/2026", 7),
    ], "end_date string, kind string, bucket string, label string, casos bigint")
    return metrics, news, runs, outcomes, series


def test_metric_table(tables):
    lines = {r.report_id: r.metric_table for r in report.metric_tables(tables[0]).collect()}
    rows = lines[1].split("\n")
    assert rows[:4] == ["## Métricas", "", "| Métrica | Valor | Período |", "|---|---|---|"]
    assert rows[4] == "| Taxa de aumento de casos | Dados insuficientes para cálculo neste período | — |"
    assert rows[5].startswith(f"| Taxa de mortalidade | 0.0005 | {PERIOD} (Casos com EVOLUCAO=3")
    assert rows[6].startswith("| Taxa de internação em UTI entre casos de SRAG | 1.2500 | ")
    assert rows[7].startswith("| Taxa de vacinação | covid: 0.0005; flu: 1.0 | ")
    assert rows[8:] == [""] and len(lines[2].split("\n")) == 6


def test_prompt(spark, tables):
    metrics, news, runs, *_ = tables
    got = {r.report_id: r.prompt for r in report.prompts(metrics, sanitized_blocks(news), news_availability(runs, news)).collect()}
    assert got[1].startswith("## Métricas do Período\n\n- Taxa de aumento de casos: Dados insuficientes para cálculo neste período.\n  Definição: (casos")
    assert "\n  Numerador: {'covid': 5, 'flu': 8} | Denominador: 8\n" in got[1]
    assert "\n  Numerador: 1 | Denominador: 2000\n" in got[1]
    assert "## Contexto de Notícias\n\n{{NEWS_CONTENT_START}}\num\n\ndois\n{{NEWS_CONTENT_END}}\n\n\n## Instrução Final\n" in got[1]
    assert "\n\n## Contexto de Notícias\nNenhuma notícia relevante" in got[2]
    bare = {r.report_id: r.prompt for r in report.prompts(metrics.limit(0), sanitized_blocks(news), news_availability(runs, news)).collect()}
    assert bare[1].startswith("## Métricas do Período\n\n## Contexto de Notícias\n\n{{NEWS_CONTENT_START}}") and set(bare) == {1, 2}


def test_whole_report(tables):
    metrics, news, runs, outcomes, series = tables
    got = {r.report_id: r.report for r in report.render_reports(runs, metrics, outcomes, news, series).collect()}
    one, two = got[1], got[2]
    sections = ["# Relatório de Vigilância SRAG\n\n## Métricas\n", "\n## Análise\n\nTexto.\n\n## Gráficos\n", "\n## Fontes e Referências\n\n1. **A** — a.br (https://a.br/1)\n2. **B** — b.br (https://b.br/2)\n",
                "\n## Metodologia e Limitações\n\n- **Fonte dos dados**: ", "\n- **Hash do arquivo**: `0123456789abcdef...`\n\n### Exclusões aplicadas\n- Colunas com dados sensíveis removidas: NU_CPF, NM_PACIENT\n\n### Vacinação\n",
                "\n\n---\n*Relatório gerado em: 20/07/2026 09:08:07 — run_id: `r-1`*\n"]
    places = [one.index(s) for s in sections]
    assert places == sorted(places) and one.endswith(sections[-1])
    assert "| 02/01 | 3 |\n| 30/01 | 4 |\n" in one and "| Jan/2026 | 7 |\n" in one
    assert "⚠️" not in one and "### Notícias" not in one
    assert "\n## Análise\n\n\n\n> ⚠️ Esta narrativa foi parcialmente validada" in two
    assert "## Fontes\n\nNenhuma notícia relevante encontrada neste período.\n" in two
    assert "- Colunas esperadas não encontradas: UTI\n\n### Notícias\n" in two and "sensíveis" not in two


def test_audit(spark, tables, tmp_path):
    metrics, news, runs, outcomes, _ = tables
    runs = runs.selectExpr("*", "'pinned' AS data_mode", "named_struct('action', 'pinned_snapshot') AS data_check_result",
                           "named_struct('pii', pii_stripped) AS exclusion_log", "map('daily_cases', 'x') AS chart_paths",
                           "IF(report_id = 2, 'boom', NULL) AS error")
    extra = runs.filter("report_id = 2").selectExpr("* EXCEPT (report_id, run_id)", "3 AS report_id", "CAST(NULL AS STRING) AS run_id")
    records = audit.audit_records(runs.unionByName(extra), metrics, outcomes, sanitized_blocks(news))
    assert len(records.columns) == 16
    audit.write_audit(records, str(tmp_path / "a"))
    audit.write_audit(records.limit(0), str(tmp_path / "a"))
    got = {r.run_id: r for r in spark.read.json(str(tmp_path / "a")).collect()}
    assert set(got) == {"r-1", "r-2", "unknown"}
    assert got["r-1"].timestamp == "2026-07-20T09:08:07.000000+00:00" and got["r-1"].news_flagged is False
    assert got["r-1"].metrics.vaccination_coverage.value.flu == 1.0 and got["r-1"].metrics.mortality_rate.numerator == 1
    assert got["r-1"].metrics.mortality_rate.query == " ".join(METRIC_SQL["mortality_rate"].split())
    assert got["r-1"].metrics.case_growth_rate.computable is False
    assert got["r-2"].metrics.uti_admission_rate is None and got["r-2"].validation_diff.numeric_mismatches[0].raw == "9"
    assert (got["unknown"].narrative_draft, got["unknown"].retry_count, got["unknown"].validation_passed) == ("", 0, False)
    assert got["r-2"].error == "boom" and got["r-2"].narrative_draft == "Rascunho 9"
