"""Snapshots of the source file: what to do about each, and their metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = "url string, filename string, etag string, last_modified string, checked_at string, sha256 string, rows bigint"
# Why a source has no usable file.
NO_CACHE = "No cached CSV available and freshness check / download failed."
NO_PINNED = "No pinned snapshot found. Run in live mode to download first."


def _same(ours: Column, theirs: Column) -> Column:
    """Equal and known; an empty header matches nothing."""
    return F.coalesce((ours == theirs) & (theirs != ""), F.lit(False))


def sync_actions(remote: DataFrame, cached: DataFrame, checked_at: str | None = None) -> DataFrame:
    """What each source needs: (url, action, error, filename, remote and cached headers, checked_at).

    `remote` is (url, mode, pinned_filename, head_ok, download_ok, etag, last_modified, failure), `cached`
    is (url, etag, last_modified, filename, file_exists). `action` is pinned_snapshot, cached_up_to_date,
    downloaded or used_cache_after_error; it is NULL, with an error, where nothing usable is left. A hit does
    not look whether the cached file still exists; falling back to it does.
    """
    known = cached.select(
        "url", F.col("etag").alias("cached_etag"), F.col("last_modified").alias("cached_last_modified"),
        F.col("filename").alias("cached_filename"), "file_exists",
    )
    joined = remote.join(known, "url", "left")
    pinned = F.col("mode") == "pinned"
    has_name = F.coalesce(F.col("cached_filename") != "", F.lit(False))
    hit = (_same(F.col("cached_etag"), F.col("etag")) | _same(F.col("cached_last_modified"), F.col("last_modified"))) & has_name
    failed = ~F.col("head_ok") | (~hit & ~F.col("download_ok"))
    usable = has_name & F.coalesce("file_exists", F.lit(False))
    action = (
        F.when(pinned, F.when(F.coalesce(F.col("pinned_filename") != "", F.lit(False)), "pinned_snapshot"))
        .when(failed, F.when(usable, "used_cache_after_error"))
        .when(hit, "cached_up_to_date")
        .otherwise("downloaded")
    )
    judged = joined.withColumn("action", action)
    online = F.col("action").isin("cached_up_to_date", "downloaded")
    return judged.select(
        "url", "action",
        F.when(F.col("action") == "used_cache_after_error", F.col("failure"))
        .when(F.col("action").isNull(), F.when(pinned, NO_PINNED).otherwise(NO_CACHE)).alias("error"),
        F.when(F.col("action") == "pinned_snapshot", F.col("pinned_filename"))
        .when(F.col("action").isin("cached_up_to_date", "used_cache_after_error"), F.col("cached_filename")).alias("filename"),
        F.when(online, F.col("etag")).alias("remote_etag"),
        F.when(online, F.col("last_modified")).alias("remote_last_modified"),
        F.when(F.col("action") == "cached_up_to_date", F.coalesce("cached_last_modified", F.lit(""))).alias("cached_last_modified"),
        F.when(F.col("action").isNotNull(), F.lit(checked_at)).cast("string").alias("checked_at"),
    )


def snapshot_metadata(cases: DataFrame, files: DataFrame, url: str, etag: str, last_modified: str, checked_at: str) -> DataFrame:
    """One metadata row per file of a fresh snapshot; `files` is the output of `source_files`.

    `cases` is the scan of those files, so the rows are counted per file through the scan's own file name.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    counts = cases.select(name.alias("filename")).groupBy("filename").agg(F.count(F.lit(1)).alias("rows"))
    return files.select(F.col("file_name").alias("filename"), "sha256").join(counts, "filename", "left").select(
        F.lit(url).alias("url"), "filename", F.lit(etag).alias("etag"), F.lit(last_modified).alias("last_modified"),
        F.lit(checked_at).alias("checked_at"), "sha256", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("append").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The stored metadata, or an empty table where none was stored yet."""
    try:
        return spark.read.schema(METADATA_SCHEMA).json(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], METADATA_SCHEMA)
        raise
