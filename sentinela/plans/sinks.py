"""Stores of one record per run that may be written again.

Every write is a batch with a name, and a batch is a partition that a repeated write replaces as a whole: a job that is run
twice, or breaks off and is started anew, leaves one copy. A run that appears in several batches counts with its latest
record. So a write costs what it writes, whatever has been stored before, and a run needs no file of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"
KEY = "run_id"


def batch_name(rows: DataFrame, key: str = KEY) -> str:
    """A name for the set of keys of `rows`, whatever their order: how many there are and the sums of digests of each."""
    half = lambda first: F.conv(F.substring("_md5", first, 15), 16, 10).cast("decimal(20, 0)")
    found = rows.select(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_md5")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b")).first()
    return f"{found.n}-{int(found.a or 0):x}-{int(found.b or 0):x}"


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, that of the greatest `order`. A key's rows combine on the map side."""
    columns = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return last.select(key, "_last.*").select(rows.columns)


def write_batch(rows: DataFrame, path: str, kind: str, batch: str | None = None, key: str = KEY) -> str:
    """Write `rows` as one batch of the table at `path`, in place of what that batch held; its name comes back.

    Without a name, the keys give it: then writing the same runs again, with whatever outcome, replaces them. That reads `rows`
    twice. No rows leave the table as it is.
    """
    name = batch_name(rows, key) if batch is None else batch
    named = rows.withColumn(BATCH, F.lit(name))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).format(kind).save(path)
    return name


def read_latest(spark: SparkSession, path: str, kind: str, order: Sequence[str], key: str = KEY, schema: str | None = None) -> DataFrame:
    """One record per run of the table at `path`, the one that comes last by `order`, then by name of batch."""
    reader = spark.read.format(kind)
    rows = (reader.schema(schema) if schema else reader).load(path).withColumn(BATCH, F.col(BATCH).cast("string"))
    return latest(rows, key, [*order, BATCH]).drop(BATCH)
