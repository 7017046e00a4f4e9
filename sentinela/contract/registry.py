"""Every registered query: (spark, folder of the tables) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.contract import adapters as a
from sentinela.functions import dates as d
from sentinela.functions.numbers import number_tokens as tokens_of
from sentinela.functions.numbers import parse_number
from sentinela.functions.text import content_text, is_injection, strip_injection, strip_markers
from sentinela.functions.urls import cited_urls, domain_tier, url_host
from sentinela.operators import coverage, delays, nearest
from sentinela.operators import facts as fa
from sentinela.operators import grounding as g
from sentinela.functions.raw import present
from sentinela.operators import metrics as m
from sentinela.operators import profiles as pr
from sentinela.operators import quality as q
from sentinela.operators import sanitize as sa
from sentinela.operators import series as s
from sentinela.plans import audit, report, sinks
from sentinela.schema import METRIC_KEYS, NEWS_DOMAINS
from sentinela.session import spread, work_folder
from sentinela.sources import cases as c
from sentinela.sources import news as n
from sentinela.sources import refresh, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


METRIC_COLUMNS = ["metric_key", "component", "value", "computable", "numerator", "denominator", "period", "definition_ref"]


@query
def case_growth(spark, sf_dir):
    cases = a.srag_between(spark, sf_dir, "1999-12-18", a.END_DATE)
    return m.single_metric(cases, "case_growth_rate", None, a.END_DATE).select(METRIC_COLUMNS)


@query
def mortality_rate(spark, sf_dir):
    cases = a.srag_between(spark, sf_dir, a.START_DATE, a.END_DATE)
    return m.single_metric(cases, "mortality_rate", a.START_DATE, a.END_DATE).select(METRIC_COLUMNS)


@query
def uti_admission(spark, sf_dir):
    cases = a.srag_between(spark, sf_dir, a.START_DATE, a.END_DATE)
    return m.single_metric(cases, "uti_admission_rate", a.START_DATE, a.END_DATE).select(METRIC_COLUMNS)


@query
def vaccination(spark, sf_dir):
    cases = a.srag_between(spark, sf_dir, a.START_DATE, a.END_DATE)
    return m.single_metric(cases, "vaccination_coverage", a.START_DATE, a.END_DATE).select(METRIC_COLUMNS)


@query
def metrics_long(spark, sf_dir):
    cases = a.srag_between(spark, sf_dir, a.START_DATE, a.END_DATE)
    return m.compute_metrics(cases, a.START_DATE, a.END_DATE).select("position", *METRIC_COLUMNS)


@query
def metrics_missing_column(spark, sf_dir):
    """The table lacks one metric's column: that metric falls back, the others stand."""
    cases = a.srag_between(spark, sf_dir, a.START_DATE, a.END_DATE).drop("UTI")
    return m.compute_metrics(cases, a.START_DATE, a.END_DATE).select("position", *METRIC_COLUMNS)


@query
def metrics_isolated(spark, sf_dir):
    """Text in one metric's column: that metric falls back, the others stand."""
    cases = a.srag_between(spark, sf_dir, a.START_DATE, a.END_DATE)
    text = F.when(F.col("EVOLUCAO") == 9, "ignorado").otherwise(F.col("UTI").cast("string"))
    return m.isolated_metrics(cases.withColumn("UTI", text), a.START_DATE, a.END_DATE).select("position", *METRIC_COLUMNS)


@query
def metrics_isolated_by_state(spark, sf_dir):
    """Cases as text; words among one state's ICU codes and another's outcomes, and onsets of a third that are no dates."""
    found = m.isolated_metrics(a.delivered(spark, sf_dir), a.START_DATE, a.END_DATE, by=["SG_UF"])
    return found.select("SG_UF", "position", *METRIC_COLUMNS, "failed", "unreadable")


@query
def metrics_by_period(spark, sf_dir):
    return m.metrics_by_period(a.srag(spark, sf_dir), a.periods(spark, sf_dir)).select("report_id", "position", *METRIC_COLUMNS)


@query
def metrics_completed(spark, sf_dir):
    """Only the computable rows are kept, and the registry's missing ones are filled in again."""
    found = a.facts(spark, sf_dir).filter("computable")
    period = F.concat_ws(" to ", *d.ordered_period(F.col("start_date"), F.col("end_date")))
    done = m.complete_metrics(found, a.periods(spark, sf_dir), ["report_id"], period)
    return done.select("report_id", "position", *METRIC_COLUMNS)


@query
def metrics_described(spark, sf_dir):
    described = m.describe_metrics(a.facts(spark, sf_dir))
    return described.select("report_id", "position", "metric_key", "component", "value", "name", "definition", "caveat")


@query
def ext_metrics_by_state(spark, sf_dir):
    cases = a.srag_by_state(spark, sf_dir)
    return m.compute_metrics(cases, a.START_DATE, a.END_DATE, by=["SG_UF"]).select("SG_UF", "position", *METRIC_COLUMNS)


@query
def ext_reporting_triangle(spark, sf_dir):
    return delays.reporting_triangle(a.reported(spark, sf_dir), ["SG_UF"])


@query
def ext_unusable_dates(spark, sf_dir):
    return delays.unusable_dates(a.reported(spark, sf_dir), ["SG_UF"])


@query
def ext_delay_ratios(spark, sf_dir):
    return delays.delay_ratios(delays.reporting_triangle(a.reported(spark, sf_dir)), a.END_DATE, max_delay=40)


@query
def ext_completed_days(spark, sf_dir):
    return delays.completed_days(delays.reporting_triangle(a.reported(spark, sf_dir), ["SG_UF"]), a.END_DATE, ["SG_UF"], max_delay=40)


@query
def ext_completed_growth(spark, sf_dir):
    return delays.completed_growth(delays.reporting_triangle(a.reported(spark, sf_dir), ["SG_UF"]), a.END_DATE, ["SG_UF"], max_delay=40)


@query
def ext_growth_by_day(spark, sf_dir):
    return s.growth_by_day(a.srag_by_state(spark, sf_dir), ["SG_UF"])


@query
def ext_daily_filled(spark, sf_dir):
    """The last days of the table, so that most states have days without cases."""
    return s.daily_by_group(a.srag_by_state(spark, sf_dir), ["SG_UF"], "1999-11-15", a.END_DATE)


@query
def ext_metrics_by_level(spark, sf_dir):
    cases = a.grouped(spark, sf_dir).withColumn("age_band", m.age_band())
    levels = [[], ["SG_UF"], ["SG_UF", "CS_SEXO"], ["age_band"]]
    return m.metrics_by_level(cases, a.START_DATE, a.END_DATE, levels).select("level", "SG_UF", "CS_SEXO", "age_band", "position", *METRIC_COLUMNS)


@query
def ext_population_coverage(spark, sf_dir):
    """Coverage by state at the ends of three periods, with the hospital-based rate where no population is known."""
    cases, found = a.srag_by_state(spark, sf_dir), []
    for start, end in a.COVERAGE_PERIODS:
        found.append(m.compute_metrics(cases, start, end, by=["SG_UF"]).withColumn("last_day", F.date_sub(F.lit(end).cast("date"), 1)))
    metrics = found[0].unionByName(found[1]).unionByName(found[2])
    covered = coverage.population_coverage(metrics, a.population(spark, sf_dir), ["SG_UF"], "last_day")
    return covered.select("SG_UF", "last_day", "component", "value", "computable", "numerator", "denominator", "period", "basis")


@query
def ext_tolerance_pairs(spark, sf_dir):
    return nearest.tolerance_join(a.stated(spark, sf_dir), a.facts(spark, sf_dir).filter("computable"))


@query
def ext_stated_metrics(spark, sf_dir):
    """Which metrics, of how many reports, the numbers of the line items may state."""
    return nearest.stated_metrics(a.stated(spark, sf_dir), a.facts(spark, sf_dir))


@query
def daily_cases(spark, sf_dir):
    return s.daily_cases(a.srag_between(spark, sf_dir, "1999-12-02", a.END_DATE), a.END_DATE)


@query
def monthly_cases(spark, sf_dir):
    return s.monthly_cases(a.srag_between(spark, sf_dir, "1998-12-17", "1999-12-17"), "1999-12-17")


@query
def series_by_period(spark, sf_dir):
    return report.series_by_end(a.srag(spark, sf_dir), a.runs(spark, sf_dir))


@query
def series_status(spark, sf_dir):
    """Series of a window with cases and of one after the last case."""
    def status(first, end, window):
        cases = a.srag_between(spark, sf_dir, first, end)
        return s.series_status(s.daily_cases(cases, end)).withColumn("window", F.lit(window))

    return status("1999-12-02", a.END_DATE, "full").unionByName(status("2019-12-02", "2020-01-01", "empty"))


@query
def local_day_counts(spark, sf_dir):
    day = d.local_date(F.col("ts")).alias("day")
    return a.read(spark, sf_dir, "events").groupBy(day).agg(F.count(F.lit(1)).alias("events"))


@query
def clean_cases(spark, sf_dir):
    return c.clean_cases(a.raw_cases(spark, sf_dir))


@query
def case_lines(spark, sf_dir):
    """Delimited lines with missing-value spellings, whole decimals and quotes, read and cleaned."""
    raw = c.parse_case_lines(a.case_lines(spark, sf_dir), a.LINE_COLUMNS)
    return c.clean_cases(raw).withColumn("rows", F.lit(1)).groupBy(*a.LINE_COLUMNS).agg(F.count("rows").alias("cases"))


@query
def page_fingerprints(spark, sf_dir):
    """What is recorded of a source file, for pages under file names, some of which end in a date."""
    pages = a.page_files(spark, sf_dir)
    found = c.fingerprint(F.col("html").cast("binary"))
    return pages.select(
        "page_id", *[v.alias(k) for k, v in found.items()], c.extraction_date(F.col("file_name")).alias("extraction_date"))


@query
def exclusion_log(spark, sf_dir):
    return q.exclusion_log(a.raw_cases(spark, sf_dir), c.DEFAULT_ENCODING)


@query
def loaded_case_files(spark, sf_dir):
    """Case files read by their header, cleaned, and counted through the view they are given."""
    c.load_cases(spark, a.case_files(spark, sf_dir), view="loaded_cases")
    return spark.sql("SELECT DT_SIN_PRI, EVOLUCAO, UTI, SG_UF, CS_SEXO, count(*) AS cases FROM loaded_cases GROUP BY ALL")


@query
def snapshot_metadata(spark, sf_dir):
    """The metadata of a downloaded snapshot, stored and read back: as many rows as files, whose names Spark chooses."""
    folder, store = a.case_files(spark, sf_dir), work_folder(spark)
    found = snapshots.snapshot_metadata(
        c.read_case_csv(spark, folder), c.source_files(spark, f"{folder}/*.csv"), "https://dados.example/srag.csv", "e1", "2026-07-20", "2026-07-21T00:00:00")
    snapshots.write_metadata(found, store)
    kept = snapshots.read_metadata(spark, store)
    return kept.groupBy("url", "etag", "last_modified", "checked_at").agg(
        F.sum("rows").alias("rows"), (F.count_distinct("filename") == F.count(F.lit(1))).alias("one_row_a_file"),
        F.bool_and(F.length("sha256") == 64).alias("hashed"))


@query
def column_profiles(spark, sf_dir):
    """Profiles of eight files put together, against counts over the whole: estimates within their bounds, everything else equal."""
    raw = a.profiled(spark, sf_dir)
    parts = pr.column_profiles(raw.filter("file % 2 = 0"), "ISO-8859-1", ["file"]).unionByName(pr.column_profiles(raw.filter("file % 2 = 1"), "UTF-8", ["file"]))
    merged = pr.described(pr.merge_profiles(parts), [0.5])
    columns = [k for k in raw.columns if k != "file"]
    value = {k: present(F.col(k)) for k in columns}
    exact = raw.agg(*[F.struct(F.lit(k).alias("column"), F.count_distinct(value[k]).alias("exact")).alias(k) for k in columns]).select(F.inline(F.array(*columns)))
    within = F.abs(F.col("distinct") - F.col("exact")) <= pr.DISTINCT_ERROR * F.col("exact")
    return merged.join(exact, "column").select("column", "encodings", "rows", "missing", "least", "greatest", "numbers", within.alias("distinct_within_bound"), "exact")


@query
def malformed_values(spark, sf_dir):
    raw = a.raw_cases(spark, sf_dir)
    return c.malformed_values(raw.withColumn("DT_NOTIFIC", F.replace("DT_NOTIFIC", F.lit("-02-"), F.lit("/02/"))))


@query
def source_files(spark, sf_dir):
    return c.source_files(spark, f"{sf_dir}/*.parquet")


@query
def sync_actions(spark, sf_dir):
    return snapshots.sync_actions(*a.manifests(spark, sf_dir), "2026-07-20T10:11:12+00:00")


@query
def changed_months(spark, sf_dir):
    """Which onset months of a later line list differ from the earlier one's."""
    return refresh.changed_months(*a.line_lists(spark, sf_dir))


@query
def month_digests(spark, sf_dir):
    return refresh.month_digests(a.line_lists(spark, sf_dir)[1])


@query
def number_tokens(spark, sf_dir):
    texts = a.narratives(spark, sf_dir, a.facts(spark, sf_dir))
    return texts.select("narrative_id", F.inline(tokens_of(F.col("narrative"))))


@query
def canonical_numbers(spark, sf_dir):
    """Prices and quantities of the line items spelled the Brazilian way and read back."""
    price = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    grouped = F.translate(F.format_number(F.col("l_orderkey") * 100 + F.col("l_linenumber"), 0), ",", ".")
    sign = F.when(F.col("l_linenumber") % 2 == 0, "%").otherwise(" %")
    rate = F.concat(F.translate(F.format_string("%.2f", F.col("l_discount")), ".", ","), sign)
    spelled = F.explode(F.array(price, grouped, rate, F.col("l_returnflag"), F.format_string("%.2f", F.col("l_tax"))))
    lines = spread(a.read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", spelled.alias("raw"))
    return lines.select("l_orderkey", "l_linenumber", "raw", parse_number(F.col("raw")).alias("value"))


@query
def allowed_values(spark, sf_dir):
    return fa.allowed_values(a.facts(spark, sf_dir))


@query
def news_numbers(spark, sf_dir):
    return g.news_numbers(a.news(spark, sf_dir))


@query
def numeric_mismatches(spark, sf_dir):
    facts = a.facts(spark, sf_dir)
    return g.numeric_mismatches(a.narratives(spark, sf_dir, facts), facts, a.news(spark, sf_dir))


@query
def source_mismatches(spark, sf_dir):
    narratives = a.narratives(spark, sf_dir, a.facts(spark, sf_dir))
    return g.source_mismatches(narratives, a.news(spark, sf_dir))


@query
def cited_url_counts(spark, sf_dir):
    narratives = a.narratives(spark, sf_dir, a.facts(spark, sf_dir))
    urls = narratives.select(F.explode(cited_urls(F.col("narrative"))).alias("url"))
    return urls.groupBy("url").agg(F.count(F.lit(1)).alias("narratives"))


@query
def narrative_outcome(spark, sf_dir):
    diff = F.col("validation_diff")
    facts = a.facts(spark, sf_dir)
    return g.validate_narratives(a.narratives(spark, sf_dir, facts), facts, a.news(spark, sf_dir)).select(
        "narrative_id", "report_id", "validation_passed", "narrative_validated", "retry_count",
        F.array_join(F.transform(diff["numeric_mismatches"], lambda m: m["raw"]), "|").alias("numbers"),
        F.array_join(F.transform(diff["source_mismatches"], lambda m: m["cited"]), "|").alias("urls"),
    )


@query
def injection_flags(spark, sf_dir):
    news = a.news(spark, sf_dir)
    return news.select("report_id", "pos", is_injection(strip_markers(F.col("snippet"))).alias("flagged"))


@query
def injection_strip(spark, sf_dir):
    news = a.news(spark, sf_dir).filter(is_injection(strip_markers(F.col("snippet"))))
    return news.select("report_id", "pos", strip_injection(strip_markers(F.col("snippet"))).alias("text"))


@query
def sanitized_items(spark, sf_dir):
    return sa.sanitize_items(a.news(spark, sf_dir)).select("report_id", "pos", "flagged", "text")


@query
def sanitized_block(spark, sf_dir):
    return sa.sanitized_blocks(a.news(spark, sf_dir))


@query
def content_blocks(spark, sf_dir):
    return a.contents(spark, sf_dir).select("conv_id", "turn", content_text(F.col("content")).alias("text"))


@query
def news_items(spark, sf_dir):
    return n.extract_news(a.responses(spark, sf_dir))


@query
def news_top5(spark, sf_dir):
    return n.top_news(a.news(spark, sf_dir)).select("report_id", "pos", "rank", "title", "url")


@query
def news_availability(spark, sf_dir):
    """One report per conversation; there are more of them than reports with news."""
    reports = a.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("report_id")).distinct()
    return n.news_availability(reports, n.extract_news(a.responses(spark, sf_dir)))


@query
def domain_tiers(spark, sf_dir):
    pages = a.read(spark, sf_dir, "pages").withColumn("host", url_host(F.col("url")))
    return pages.select("page_id", "host", domain_tier(F.col("host"), a.DOMAINS).alias("m")).select(
        "page_id", "host", "m.domain", "m.tier"
    )


@query
def listed_domain_tiers(spark, sf_dir):
    """The accepted news domains, looked up for hosts on, below and near them."""
    hosts = a.hosts(spark, sf_dir).withColumn("host", F.lower(F.coalesce("given", url_host(F.col("url")))))
    return hosts.select("page_id", "host", domain_tier(F.col("host"), NEWS_DOMAINS).alias("m")).select("page_id", "host", "m.domain", "m.tier")


@query
def search_queries_dated(spark, sf_dir):
    """Reports without metrics: the year comes from their own dates, the end first, some of which are none."""
    wide = fa.wide_facts(a.facts(spark, sf_dir).filter("report_id % 5 = 0"))
    dates = a.periods(spark, sf_dir).selectExpr(
        "report_id", "CASE WHEN report_id % 4 = 1 THEN 'desconhecida' WHEN report_id % 4 = 2 THEN NULL ELSE end_date END AS ends",
        "CASE WHEN report_id % 8 = 5 THEN '' ELSE start_date END AS starts")
    years = [d.year_from_period(F.col(k)["period"]) for k in ("case_growth_rate", "mortality_rate", "uti_admission_rate")]
    year = d.report_year(years, [F.col("ends"), F.col("starts")])
    return dates.join(wide, "report_id", "left").select("report_id", year.alias("year"), d.search_query(year).alias("query"))


@query
def search_queries(spark, sf_dir):
    wide = fa.wide_facts(a.facts(spark, sf_dir))
    years = [d.year_from_period(F.col(k)["period"]) for k in ("case_growth_rate", "mortality_rate", "uti_admission_rate")]
    year = d.report_year(years, [])
    return wide.select("report_id", year.alias("year"), d.search_query(year).alias("query"))


@query
def metric_table_rows(spark, sf_dir):
    return report.metric_tables(a.facts(spark, sf_dir))


@query
def prompt_rows(spark, sf_dir):
    news = a.news(spark, sf_dir)
    available = n.news_availability(a.periods(spark, sf_dir), news)
    return report.prompts(a.facts(spark, sf_dir), sa.sanitized_blocks(news), available)


@query
def sources_list(spark, sf_dir):
    return report.source_lists(a.news(spark, sf_dir))


def _outcomes(spark, sf_dir, facts, news):
    """The draft and the outcome of every run; each narrative is a run of its report.

    One without an id is no run. That is said here, and that no run_id is NULL: Spark would filter the two readings of the
    narratives each in its own way, and shuffle them twice.
    """
    drafts = a.narratives(spark, sf_dir, facts).filter("narrative_id IS NOT NULL")
    run_id = F.coalesce(F.concat(F.lit("run-"), F.col("narrative_id").cast("string")), F.lit(""))
    found = g.validate_narratives(drafts, facts, news, keep=["narrative"])
    return found.withColumn("run_id", run_id).drop("narrative_id", "report_id")


@query
def report_text(spark, sf_dir):
    cases, runs = a.srag(spark, sf_dir), a.runs(spark, sf_dir)
    facts, news = a.facts(spark, sf_dir), a.news(spark, sf_dir)
    outcomes = _outcomes(spark, sf_dir, facts, news)
    return report.render_reports(runs, facts, outcomes, news, report.series_by_end(cases, runs))


def _with_failures(spark, sf_dir, facts):
    """The admission rate of every seventh report, and coverage of every eleventh, as they are where the metric failed."""
    found = facts.filter("NOT (report_id % 7 = 3 AND metric_key = 'uti_admission_rate' OR report_id % 11 = 4 AND metric_key = 'vaccination_coverage')")
    period = F.concat_ws(" to ", *d.ordered_period(F.col("start_date"), F.col("end_date")))
    return m.complete_metrics(found, a.periods(spark, sf_dir), ["report_id"], period)


@query
def latest_runs(spark, sf_dir):
    """Every run once, of those that were run again the last record."""
    return sinks.latest(a.run_records(spark, sf_dir), "run_id", ["timestamp", "batch"])


@query
def audit_rows(spark, sf_dir):
    runs = a.runs(spark, sf_dir).select(
        "*", F.struct(F.lit("pinned_snapshot").alias("action")).alias("data_check_result"),
        F.struct("pii_stripped", "columns_not_found").alias("exclusion_log"),
        F.create_map(F.lit("daily_cases"), F.lit("daily")).alias("chart_paths"),
    )
    facts, news = a.facts(spark, sf_dir), a.news(spark, sf_dir)
    outcomes = _outcomes(spark, sf_dir, facts, news)
    facts = _with_failures(spark, sf_dir, facts)
    records = audit.audit_records(runs, facts, outcomes, sa.sanitized_blocks(news))
    m, diff = F.col("metrics"), F.col("validation_diff")
    fields = ("value", "computable", "numerator", "denominator", "period", "definition_ref", "query")
    plain = [m[k][f].alias(f"{k}_{f}") for k in METRIC_KEYS if k != "vaccination_coverage" for f in fields]
    parts = [m["vaccination_coverage"][f][c].alias(f"{c}_{f}") for f in ("value", "numerator") for c in ("covid", "flu")]
    parts += [m["vaccination_coverage"][f].alias(f"vaccination_{f}") for f in fields if f not in ("value", "numerator")]
    return records.select(
        "run_id", "timestamp", "data_mode", "source_csv_hash", "source_extraction_date", "news_source", "news_flagged",
        "narrative_draft", "retry_count", "validation_passed", "error",
        F.col("data_check_result.action").alias("sync_action"),
        F.array_join("exclusion_log.pii_stripped", ",").alias("pii_stripped"),
        F.array_join("exclusion_log.columns_not_found", ",").alias("columns_not_found"),
        F.col("chart_paths")["daily_cases"].alias("daily_chart"),
        F.array_join(F.transform(diff["numeric_mismatches"], lambda n: n["raw"]), "|").alias("numbers"),
        F.array_join(F.transform(diff["source_mismatches"], lambda n: n["cited"]), "|").alias("urls"),
        *plain, *parts,
    )
