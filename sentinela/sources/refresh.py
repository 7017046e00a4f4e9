"""Incremental refresh of stored cases: a new line list replaces only the onset months whose rows differ.

A month's digest does not depend on the order of its rows: the number of rows, and the sums of both halves of a digest of each.
Equal months have equal digests however they are split over files and tasks; the sums combine on the map side, so a month
with a third of all cases is one small row per task. The digests of the stored months are kept beside the data, one set for
each snapshot, written after the data: a refresh that breaks off leaves the older set in force, and the next one rewrites
what it had rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.schema import ONSET

MONTH = "onset_month"
DIGESTS = f"{MONTH} string, rows bigint, digest string, snapshot string"
# Folders that begin with an underscore are no part of the table they lie in.
FOLDER = "_months"


def onset_month() -> Column:
    return F.date_format(ONSET, "yyyy-MM")


def row_digest(columns: Sequence[str]) -> Column:
    """MD5 of a row: each value as length and text, so that no two rows read alike; NULL is apart from any text."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws(",", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def month_digests(cases: DataFrame) -> DataFrame:
    """(onset_month, rows, digest) of each month of the cases; those without onset are the month NULL."""
    half = lambda first: F.conv(F.substring("_md5", first, 15), 16, 10).cast("decimal(20, 0)")
    rows = cases.select(onset_month().alias(MONTH), row_digest(cases.columns).alias("_md5"))
    summed = rows.groupBy(MONTH).agg(F.count(F.lit(1)).alias("rows"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b"))
    return summed.select(MONTH, "rows", F.concat_ws(":", "rows", "a", "b").alias("digest"))


def compare_months(before: DataFrame, now: DataFrame) -> DataFrame:
    """(onset_month, change, rows_before, rows_now) for two outputs of `month_digests`; change is added, removed, changed or same."""
    old, new = before.alias("old"), now.alias("new")
    both = old.join(new, F.col(f"old.{MONTH}").eqNullSafe(F.col(f"new.{MONTH}")), "full")
    change = (
        F.when(F.col("old.digest").isNull(), "added").when(F.col("new.digest").isNull(), "removed")
        .when(F.col("old.digest") == F.col("new.digest"), "same").otherwise("changed")
    )
    return both.select(
        F.coalesce(f"old.{MONTH}", f"new.{MONTH}").alias(MONTH), change.alias("change"),
        F.col("old.rows").alias("rows_before"), F.col("new.rows").alias("rows_now"))


def changed_months(before: DataFrame, now: DataFrame) -> DataFrame:
    """`compare_months` of two line lists with the same columns."""
    return compare_months(month_digests(before), month_digests(now.select(before.columns)))


def stored_months(spark: SparkSession, path: str) -> DataFrame:
    """The digests of the last snapshot stored at `path`, or none."""
    try:
        kept = spark.read.schema(DIGESTS).parquet(f"{path}/{FOLDER}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DIGESTS)
    return kept.filter((F.col("snapshot") == kept.agg(F.max("snapshot")).scalar()) & F.col("digest").isNotNull())


def refresh_cases(cases: DataFrame, path: str, snapshot: str) -> DataFrame:
    """Bring the cases stored at `path`, by onset month, to the state of `cases`; what changed comes back, from `compare_months`.

    Months that are new or differ are written anew, each replaced as a whole; no file of another month is touched. `snapshot`
    orders snapshots (a time as ISO text); repeating one gives the same state. A month that is gone keeps its files, but
    `read_cases` does not show it any more.
    """
    spark = cases.sparkSession
    staged = f"{path}/_staged/{snapshot}"
    month_digests(cases).coalesce(1).write.mode("overwrite").parquet(staged)
    now = spark.read.schema(f"{MONTH} string, rows bigint, digest string").parquet(staged)
    # at most one row per calendar month, collected before the stored digests change
    changes = compare_months(stored_months(spark, path), now)
    changes = spark.createDataFrame(changes.collect(), changes.schema)
    touched = changes.filter("change IN ('added', 'changed')").select(F.col(MONTH).alias("_month"))
    rows = cases.withColumn(MONTH, onset_month())
    rows = rows.join(touched, F.col(MONTH).eqNullSafe(F.col("_month")), "left_semi")
    rows.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    # a row without digest tells of a snapshot without cases
    kept = now.unionByName(spark.createDataFrame([(None, 0, None)], now.schema)).withColumn("snapshot", F.lit(snapshot))
    kept.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(f"{path}/{FOLDER}")
    return changes


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of the last snapshot stored at `path`. The list of months prunes the scan's partitions."""
    rows = spark.read.parquet(path)
    kept = stored_months(spark, path).select(F.col(MONTH).alias("_month"))
    found = rows.withColumn(MONTH, F.col(MONTH).cast("string")).join(kept, F.col(MONTH).eqNullSafe(F.col("_month")), "left_semi")
    return found.drop(MONTH)
