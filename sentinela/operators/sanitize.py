"""News items made safe to quote, and the quoted block of each report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.functions.text import BLOCK_END, BLOCK_START, is_injection, strip_injection, strip_markers


def sanitize_items(news: DataFrame) -> DataFrame:
    """Each item with `flagged` and its cleaned `text`; NULL text where nothing was left of a flagged item.

    Row by row, without a shuffle, so it also runs on a stream of items. A missing snippet is empty text.
    """
    bare = strip_markers(F.coalesce(F.col("snippet").cast("string"), F.lit("")))
    marked = news.withColumn("text", bare).withColumn("flagged", is_injection(F.col("text")))
    return marked.withColumn("text", F.when(F.col("flagged"), F.nullif(strip_injection(F.col("text")), F.lit(""))).otherwise(F.col("text")))


def sanitized_blocks(news: DataFrame) -> DataFrame:
    """One delimited block per report, of all its items in order: (report_id, sanitized_news, news_flagged).

    A block is a single text in one row, so its size is that of the report's own items.
    """
    blocks = sanitize_items(news).groupBy("report_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))).alias("items"),
        F.max("flagged").alias("news_flagged"),
    )
    body = F.array_join(F.transform("items", lambda i: i["text"]), "\n\n")
    block = F.concat(F.lit(BLOCK_START + "\n"), body, F.lit("\n" + BLOCK_END))
    return blocks.select(
        "report_id", F.when(F.size("items") > 0, block).otherwise("").alias("sanitized_news"), "news_flagged"
    )
