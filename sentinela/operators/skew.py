"""Equality joins in which one key may hold a large share of the rows.

Spark's adaptive skew join splits a partition only where both inputs of a join come straight from a shuffle.
Here the smaller input is an aggregate already hashed by the key, so hot keys are split by hand: their rows
are dealt over several parts, and their few lookup rows are repeated once per part. Other keys are untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "_part"
# A key is hot with more than one row in a thousand, so there are a thousand of them at most.
SHARE = 1000
MIN_ROWS = 50_000


def hot_keys(rows: DataFrame, keys: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """(keys, parts) of the hot keys of `rows`; a part holds about a thousandth of all rows.

    Counts combine on the map side and read the key columns only. Groups of up to `min_rows` rows are left
    alone whatever their share.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    part_rows = F.greatest(F.ceil(total / SHARE), F.lit(min_rows))
    hot = counts.withColumn("part_rows", part_rows).filter(F.col("n") > F.col("part_rows"))
    return hot.select(*keys, F.ceil(F.col("n") / F.col("part_rows")).cast("int").alias("parts"))


def split_hot(rows: DataFrame, hot: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """`rows` with the part each belongs to: 0, or one of its hot key's parts by the row's id.

    A NULL key matches no lookup row, so such rows are dealt over SHARE parts however many there are.
    """
    unmatched = reduce(or_, [F.col(k).isNull() for k in keys])
    parts = F.when(unmatched, F.lit(SHARE)).otherwise(F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64(row_id), parts).cast("int")
    return rows.join(F.broadcast(hot), list(keys), "left").withColumn(PART, part).drop("parts")


def repeat_hot(lookup: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`lookup` with the rows of hot keys repeated for each of their parts."""
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return lookup.join(F.broadcast(hot), list(keys), "left").select(*lookup.columns, F.explode(parts).alias(PART))
