"""Column profiles of case files, stored per file or snapshot and put together without reading the files again.

Of every column a profile has the number of rows and of missing values, the least and the greatest value, and two sketches:
of the distinct values, off by 1.6 % in the standard case, and of the values that are numbers, whose quantiles are off by
1.4 % of the rows. Counts add up, and sketches of parts merge into one like that of the whole, within the same bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.functions.raw import present

PROFILE = ("column", "rows", "missing", "least", "greatest", "distinct_sketch", "number_sketch")
DISTINCT_ERROR = 0.05  # three standard errors of a sketch of 2 ** 12 registers
RANK_ERROR = 0.014


def column_profiles(raw: DataFrame, encoding: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, encoding, PROFILE) of every other column of `raw`, in one pass; `encoding` is that the file was read with."""
    columns = [c for c in raw.columns if c not in by]
    def one(c: str):
        value = present(F.col(c).cast("string"))
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(value.isNull()).alias("missing"), F.min(value).alias("least"),
            F.max(value).alias("greatest"), F.hll_sketch_agg(value).alias("distinct_sketch"), F.kll_sketch_agg_double(value.try_cast("double")).alias("number_sketch"))
    counted = raw.groupBy(*by).agg(*[one(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return counted.select(*by, F.lit(encoding).alias("encoding"), F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, encodings, PROFILE): the profiles of several files as one, with the encodings they were read with."""
    return profiles.groupBy(*by, "column").agg(
        F.array_join(F.array_sort(F.collect_set("encoding")), ",").alias("encodings"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("number_sketch").alias("number_sketch"))


def described(profiles: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Profiles with `distinct`, the estimated number of distinct values, `numbers`, how many values are numbers, and `quantiles` of
    these, NULL without any, in place of the sketches."""
    numbers = F.kll_sketch_get_n_double("number_sketch")
    at = [F.kll_sketch_get_quantile_double("number_sketch", F.lit(q)) for q in quantiles]
    found = profiles.withColumns({"distinct": F.hll_sketch_estimate("distinct_sketch"), "numbers": numbers, "quantiles": F.when(numbers > 0, F.array(*at))})
    return found.drop("distinct_sketch", "number_sketch")
