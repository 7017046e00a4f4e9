"""News search responses as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.functions.text import variant_text
from sentinela.schema import MAX_NEWS_ITEMS

# With it a repeated key of an object keeps its last value, instead of making the whole response unreadable.
DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"
# Fields of a news row and the response fields they come from.
FIELDS = {"title": "title", "url": "url", "source": "source", "published_date": "published_date", "snippet": "content"}


def _field(item: Column, name: str) -> Column:
    """Text of a field; a missing field is empty, an explicit null reads None."""
    return F.coalesce(variant_text(F.try_variant_get(item, f"$.{name}", "variant")), F.lit(""))


def extract_news(responses: DataFrame) -> DataFrame:
    """Responses `(report_id, response)`, JSON text, to rows `(report_id, pos, title, url, …, snippet)`.

    `pos` is the entry's place in its response; other columns of the responses are kept. Entries that are no objects are skipped; a response whose `results` is no list gives no rows.
    """
    if responses.sparkSession.conf.get(DUPLICATE_KEYS, "false").lower() != "true":
        raise ValueError(f"set {DUPLICATE_KEYS} to true, or a response with a repeated key cannot be read; build_session does")
    results = F.try_variant_get(F.try_parse_json("response"), "$.results", "variant")
    listed = F.when(F.schema_of_variant(results).startswith("ARRAY"), F.try_variant_get(results, "$", "array<variant>"))
    keep = [c for c in responses.columns if c != "response"]
    entries = responses.select(*keep, F.posexplode(listed).alias("pos", "entry"))
    objects = entries.filter(F.schema_of_variant("entry").startswith("OBJECT"))
    fields = [_field(F.col("entry"), source).alias(name) for name, source in FIELDS.items()]
    return objects.select(*keep, "pos", *fields)


def top_news(news: DataFrame, limit: int = MAX_NEWS_ITEMS) -> DataFrame:
    """The first `limit` items of each report, in response order.

    Spark keeps at most `limit` rows per report and task before the shuffle, so a report with a third of
    all items sends a handful of rows from each task.
    """
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy("pos"))
    return news.withColumn("rank", rank).filter(F.col("rank") <= limit)


def news_availability(reports: DataFrame, news: DataFrame) -> DataFrame:
    """`tavily` for reports with any item, else `unavailable`: (report_id, news_source, items)."""
    counts = news.groupBy("report_id").agg(F.count(F.lit(1)).alias("items"))
    joined = reports.select("report_id").join(counts, "report_id", "left")
    items = F.coalesce("items", F.lit(0).cast("long"))
    return joined.select(
        "report_id", F.when(items > 0, "tavily").otherwise("unavailable").alias("news_source"), items.alias("items")
    )
