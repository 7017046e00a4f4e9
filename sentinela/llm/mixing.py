"""Mixing sources to target weights, by temperature, in DataFrame operations only.

Weights are the sources' token shares to the power of an exponent between 0 (all alike) and 1 (as they are). Bisection
finds the largest exponent that reaches a target entropy, but never one that shows a source more than `max_passes` times
as often as the least shown one. Each source then gives its budget of tokens in passes over its documents; each pass is a
permutation of its own, and the last pass stops at the budget. All streams are cut into the same number of blocks, so that
each block has the target weights, and each block is shuffled.

Offsets within a pass are two-level prefix sums: a pass is dealt to SLICES ranges of its hash order, ranges are summed and
run up, and only rows of one range are sorted together. A source with a third of all rows is as many slices as any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm.common import stored

ENTROPY = 0.9
MAX_PASSES = 4.0
BLOCK_TOKENS = 1_000_000
SLICE_BITS = 12
STEPS = 52
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"


def _flat_enough(shares: DataFrame, sources: int, entropy: float) -> float:
    """The largest exponent in [0, 1] at which the weights' entropy, as a share of the most that as many sources can have, is
    `entropy` or more. Bisection, LEVELS halvings for each pass over the sources: sums for all the middles they may come to."""
    if sources < 2:
        return 1.0
    lo, hi, done = 0.0, 1.0, 0
    while done < STEPS:
        points = [lo + (hi - lo) * k / (1 << LEVELS) for k in range(1, 1 << LEVELS)] + [hi]
        power = lambda a: F.pow(F.col("share"), F.lit(a))
        sums = shares.agg(
            F.array(*[F.sum(power(a)) for a in points]).alias("s"), F.array(*[F.sum(power(a) * F.log("share")) for a in points]).alias("l")).first()
        holds = [(math.log(x) - a * y / x) / math.log(sources) >= entropy for a, x, y in zip(points, sums["s"], sums["l"], strict=True)]
        if done == 0 and holds[-1]:
            return 1.0
        at = 0
        for level in range(LEVELS):
            middle = at + (1 << (LEVELS - 1 - level))
            at = middle if holds[middle - 1] else at
        lo, hi, done = lo + (hi - lo) * at / (1 << LEVELS), lo + (hi - lo) * (at + 1) / (1 << LEVELS), done + LEVELS
    return lo


def _rare_enough(spread: float, max_passes: float) -> float:
    """The least exponent at which sources whose largest share is `spread` times the smallest are shown `max_passes` times as often at most."""
    if spread <= max_passes:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if spread**middle <= max_passes else (lo, middle)
    return 1.0 - lo


PLAN = "source string, tokens bigint, exponent double, weight double, budget bigint, whole bigint, rest bigint"


def source_plan(counted: DataFrame, entropy: float = ENTROPY, max_passes: float = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """(source, tokens, exponent, weight, budget, whole, rest) of each source of `counted` (source, n_tokens).

    `whole` passes and `rest` tokens of another make the source's budget. Without `budget`, it is the least at which every
    document is shown. Sources without tokens are left out. Sources stay rows, however many there are; to the driver come sums.
    """
    sums = stored(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    of_all = sums.agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not of_all["n"]:
        return counted.sparkSession.createDataFrame([], PLAN)
    shares = sums.withColumn("share", F.col("tokens") / F.lit(of_all["total"]))
    spread = (of_all["most"] / of_all["total"]) / (of_all["least"] / of_all["total"])
    exponent = max(_flat_enough(shares, of_all["n"], entropy), _rare_enough(spread, max_passes))
    raw = shares.withColumn("raw", F.pow("share", F.lit(exponent)))
    weight = F.col("raw") / F.lit(raw.agg(F.sum("raw")).first()[0])
    rows = raw.withColumn("weight", weight)
    if budget is None:
        given = F.round(F.col("weight") / F.lit(rows.agg(F.min(F.col("weight") / F.col("tokens"))).first()[0]))
    else:
        given = F.floor(F.col("weight") * budget)
    rows = rows.select("source", "tokens", F.lit(exponent).alias("exponent"), "weight", given.cast("bigint").alias("budget"))
    return rows.withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.col("budget") % F.col("tokens"))


def counted_words(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens): words of each text; null texts have none, a null source is the source ''."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"))


def place(doc_id: str, turn: Column, salt: str) -> Column:
    """A document's place in the hash order of a pass: 60 bits of a digest."""
    text = F.concat_ws(":", F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), turn.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def drawn(counted: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, pass, n_tokens, place, start, block, slot): every showing of a document.

    `start` is the showing's offset in its source's stream, `slot` its position in its block, from 0. Whole passes show every
    document; the one that the budget cuts takes those that start before it ends.
    """
    few = plan.select("source", "tokens", "budget", "whole", "rest")
    all_budget = plan.agg(F.sum("budget").alias("n"))
    passes = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1))
    passes = F.when((F.col("rest") > 0) | (F.col("whole") > 0), passes)
    rows = counted.join(few, "source").select("*", F.explode(passes).alias("pass"))
    rows = rows.withColumn("place", place("doc_id", F.col("pass"), "pass"))
    rows = rows.withColumn("slice", F.shiftright("place", 60 - SLICE_BITS))
    key = ["source", "pass", "slice"]
    run_up = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*key).agg(F.sum("n_tokens").alias("in_slice"))
    bases = bases.select(*key, F.coalesce(F.sum("in_slice").over(run_up), F.lit(0)).alias("base"))
    within = Window.partitionBy(*key).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(bases, key)
    rows = rows.withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rows = rows.withColumn("start", F.col("pass") * F.col("tokens") + F.col("at")).filter("pass < whole OR start < budget")
    blocks = F.greatest(F.lit(1).cast("bigint"), F.ceil(all_budget.scalar() / F.lit(float(block_tokens))))
    # a text without tokens may stand just where the budget ends
    rows = rows.withColumn("block", F.least(F.floor(F.col("start") / F.col("budget") * blocks).cast("bigint"), blocks - 1))
    shuffled = Window.partitionBy("block").orderBy(place("doc_id", F.col("pass"), "block"), "doc_id", "source", "pass", "start")
    rows = rows.withColumn("slot", F.row_number().over(shuffled).cast("bigint") - 1)
    return rows.select("doc_id", "source", "pass", "n_tokens", "place", "start", "block", "slot")


def mix_sources(docs: DataFrame, entropy: float = ENTROPY, max_passes: float = MAX_PASSES, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture of `docs` (doc_id, source, text; other columns are ignored): see `drawn`.

    A null source is the source ''. Empty and null texts have no tokens; they take part where their source has tokens.
    Repeated rows are shown each. A single source has weight 1. A null id counts as '' in the hash order and stays null. An
    empty table, or one without tokens, gives an empty one.
    """
    counted = stored(counted_words(docs))
    return drawn(counted, stored(source_plan(counted, entropy, max_passes, budget)), block_tokens)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with each row as often as the mixture shows it: all columns of `docs`, in no order.

    The last pass of a source is everything up to its last place, so a bound per source, one row each, decides for every
    row. Texts are shuffled only where there are so many sources that Spark does not broadcast these rows. Documents of one place, such as repeated rows, are shown or left out together.
    """
    counted = stored(counted_words(docs))
    plan = stored(source_plan(counted, **settings))
    shown = drawn(counted, plan)
    last = shown.groupBy("source", "pass").agg(F.max("place").alias("last")).join(plan, "source").filter("pass = whole")
    bound = plan.select("source", "whole").join(last.select("source", "last"), "source", "left")
    bound = stored(bound.select(F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("last").alias("_mix_last")))
    rows = docs.join(bound, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_mix_source"))
    again = (place("doc_id", F.col("_mix_whole"), "pass") <= F.coalesce("_mix_last", F.lit(-1))).cast("bigint")
    return rows.withColumn("_mix_times", F.explode(F.array_repeat(F.lit(1), (F.col("_mix_whole") + again).cast("int")))).select(*docs.columns)
