"""Which numbers and URLs of a narrative no metric and no news item supports.

Narratives are `(narrative_id, report_id, narrative, retry_count)`, metrics the long metric rows with
`report_id`, news `(report_id, pos, title, snippet, url)`. A report may have any number of narratives and
items; `min_rows` is the number of narratives up to which a report is never split over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.functions.direction import is_grounded
from sentinela.functions.numbers import number_values
from sentinela.functions.text import content_text, strip_mismatches
from sentinela.functions.urls import cited_urls, normalize_url
from sentinela.operators.facts import allowed_numbers, wide_facts
from sentinela.operators.skew import MIN_ROWS, PART, hot_keys, repeat_hot, split_hot
from sentinela.schema import MAX_ATTEMPTS

# Fixed value: appended to a narrative published with claims taken out.
NOTICE = "\n\n> ⚠️ Narrativa parcialmente validada — consulte a tabela de métricas oficiais."


def _news_blob(news: DataFrame) -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))


def news_numbers(news: DataFrame) -> DataFrame:
    """Distinct values found in each report's news: (report_id, value).

    What an item states is made distinct before it is taken apart too: then Spark reads the items alone, without a table that
    is only joined to them for their other columns, and no text is shuffled.
    """
    values = F.array_distinct(F.transform(number_values(_news_blob(news)), lambda t: t["value"]))
    items = news.select("report_id", values.alias("values")).distinct()
    # an expression again, not the column, see `_number_claims`
    return items.select("report_id", F.explode(F.array_distinct("values")).alias("value")).distinct()


def known_urls(news: DataFrame) -> DataFrame:
    """Distinct non-empty URLs of each report's news: (report_id, url)."""
    return news.filter(F.col("url") != "").select("report_id", normalize_url(F.col("url")).alias("url")).distinct()


def _with_reports(claims: DataFrame, narratives: DataFrame, reports: DataFrame, min_rows: int) -> DataFrame:
    """Claims of narratives joined to their report's row.

    A report may hold a large share of all narratives, so its narratives are dealt over parts and its row is
    repeated for each. No narrative meets another report's row. Claims are shuffled, whole texts are not.
    """
    hot = hot_keys(narratives, ["report_id"], min_rows)
    rows = split_hot(claims, hot, ["report_id"], "narrative_id")
    return rows.join(repeat_hot(reports, hot, ["report_id"]), ["report_id", PART], "left").drop(PART)


def _ungrounded(claims: DataFrame, narratives: DataFrame, metrics: DataFrame, min_rows: int) -> DataFrame:
    """The claims, numbers or URLs, that state none of their report's allowed values."""
    joined = _with_reports(claims, narratives, _allowed(metrics), min_rows)
    value, context = F.col("value"), F.col("context")
    grounded = F.coalesce(F.exists("allowed", lambda a: is_grounded(value, a, context)), F.lit(False))
    return joined.filter((F.col("url") != "") | ~grounded).drop("allowed", "context")


def _unknown(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """The claims, one row per occurrence, whose keys no fact has; facts are distinct on the keys.

    One claim may occur in a large share of all narratives. The adaptive skew join splits its rows, provided
    both inputs come straight from a shuffle. Distinct facts are hashed by the keys already and would not be
    shuffled again, so their keys pass through expressions that change no value but hide that.
    """
    anew = {"value": F.col("value") + F.lit(0.0), "url": F.concat("url", F.lit(""))}
    return claims.join(facts.withColumns({k: anew[k] for k in keys[1:]}), keys, "left_anti")


def _allowed(metrics: DataFrame) -> DataFrame:
    """(report_id, allowed): the values a report's metrics let its narratives state, fifty at most."""
    return wide_facts(metrics).select("report_id", allowed_numbers().alias("allowed"))


def _number_claims() -> Column:
    """The numbers of `narrative` with their place in the text and the words before them.

    Always given to a generator as an expression, never through a column of its own: Spark would add a filter
    on such a column, push it down and evaluate the expression once more for it.
    """
    return F.transform(
        number_values(F.col("narrative")),
        lambda t, i: F.struct(
            i.alias("pos"), t["raw"].alias("raw"), t["value"].alias("value"), F.lit("").alias("url"), t["context"].alias("context")
        ),
    )


def numeric_mismatches(
    narratives: DataFrame, metrics: DataFrame, news: DataFrame, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Numbers supported by neither metrics nor news: (narrative_id, report_id, pos, raw, value)."""
    claims = narratives.select("narrative_id", "report_id", F.inline(_number_claims()))
    found = _ungrounded(claims, narratives, metrics, min_rows).drop("url")
    unknown = _unknown(found, news_numbers(news), ["report_id", "value"])
    return unknown.select("narrative_id", "report_id", "pos", "raw", "value")


def source_mismatches(narratives: DataFrame, news: DataFrame) -> DataFrame:
    """URLs that are not among the report's news: (narrative_id, report_id, cited, type)."""
    cited = narratives.select("narrative_id", "report_id", F.explode(cited_urls(F.col("narrative"))).alias("url"))
    unknown = _unknown(cited, known_urls(news), ["report_id", "url"])
    return unknown.select("narrative_id", "report_id", F.col("url").alias("cited"), F.lit("url").alias("type"))


def _all_mismatches(narratives: DataFrame, metrics: DataFrame, news: DataFrame, min_rows: int) -> DataFrame:
    """Numbers and URLs to verify and what the news knows, as one kind of key, in a single anti-join."""
    url_claims = F.transform(
        cited_urls(F.col("narrative")),
        lambda u: F.struct(F.lit(-1).alias("pos"), F.lit("").alias("raw"), F.lit(0.0).alias("value"), u.alias("url"), F.lit("").alias("context")),
    )
    stated = narratives.select("narrative_id", "report_id", F.inline(F.concat(_number_claims(), url_claims)))
    claims = _ungrounded(stated, narratives, metrics, min_rows)
    numbers = news_numbers(news).withColumn("url", F.lit(""))
    facts = numbers.unionByName(known_urls(news).withColumn("value", F.lit(0.0)))
    return _unknown(claims, facts, ["report_id", "value", "url"])


def _text() -> Column:
    """What is checked and published of `narrative`."""
    return F.coalesce(content_text(F.col("narrative")), F.lit(""))


def _checked(narratives: DataFrame, metrics: DataFrame, news: DataFrame, min_rows: int) -> DataFrame:
    """Narratives with their unsupported `numbers` and `urls`: claims are anti-joined, gathered and joined back.

    A report may have any number of items. What is gathered is one narrative's own numbers and URLs, by its id. They meet it by
    an aggregate of that id: Spark would read the narratives for their claims without NULL ids otherwise, unlike for their
    outcome, and whatever shuffles the texts before would do so twice.
    """
    texts = narratives.withColumn("narrative", _text())
    gathered = _all_mismatches(texts, metrics, news, min_rows).groupBy("narrative_id").agg(
        F.max("narrative_id").alias("_narrative_id"),
        F.array_sort(F.collect_list(F.when(F.col("url") == "", F.struct("pos", "raw", "value")))).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("url") != "", F.col("url")))).alias("urls"),
    )
    numbers = F.transform("found", lambda n: F.struct(n["raw"].alias("raw"), n["value"].alias("value")))
    return narratives.join(gathered.drop("narrative_id"), F.col("narrative_id") == F.col("_narrative_id"), "left").select(
        *narratives.columns,
        F.coalesce(numbers, F.array().cast("array<struct<raw:string,value:double>>")).alias("numbers"),
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
    )


def validate_narratives(
    narratives: DataFrame, metrics: DataFrame, news: DataFrame, min_rows: int = MIN_ROWS, keep: Sequence[str] = ()
) -> DataFrame:
    """Outcome per narrative: passed, to be retried, or published with its unsupported claims taken out.

    A narrative may be a JSON list of content blocks; its text is what is checked and published. A NULL one is empty text,
    which states nothing and passes. Every item of a report's news counts. `keep` names columns of `narratives` to put out as
    they were given.
    """
    checked = _checked(narratives, metrics, news, min_rows).withColumn("_text", _text())
    passed = (F.size("numbers") == 0) & (F.size("urls") == 0)
    attempts = F.col("retry_count") + F.lit(1)
    cleaned = strip_mismatches(F.col("_text"), F.transform("numbers", lambda n: n["raw"]), F.col("urls"))
    diff = F.struct(
        F.col("numbers").alias("numeric_mismatches"),
        F.transform("urls", lambda u: F.struct(u.alias("cited"), F.lit("url").alias("type"))).alias("source_mismatches"),
    )
    return checked.select(
        "narrative_id", "report_id",
        passed.alias("validation_passed"),
        F.when(passed, F.col("_text")).when(attempts >= MAX_ATTEMPTS, F.concat(cleaned, F.lit(NOTICE)))
        .otherwise("").alias("narrative_validated"),
        F.when(~passed, diff).alias("validation_diff"),
        F.when(passed, F.col("retry_count")).otherwise(attempts).alias("retry_count"),
        *keep,
    )
