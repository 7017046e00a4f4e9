"""Hot keys are split, and joins on split keys give what plain joins give."""

from collections import Counter

import pytest

from sentinela.operators import grounding as g
from sentinela.operators.skew import PART, hot_keys, repeat_hot, split_hot


def test_split_join_equals_plain_join(spark):
    rows = spark.range(20000).selectExpr("id", "CAST(CASE WHEN id % 3 = 0 THEN 0 WHEN id % 7 = 0 THEN 1 ELSE id % 500 + 2 END AS INT) AS k")
    lookup = spark.range(0, 400).selectExpr("CAST(id AS INT) AS k", "id * 10 AS v")
    hot = hot_keys(rows, ["k"], 100)
    parts = {r.k: r.parts for r in hot.collect()}
    assert set(parts) == {0, 1} and parts[0] == 67 and parts[1] == 20
    left, right = split_hot(rows, hot, ["k"], "id"), repeat_hot(lookup, hot, ["k"])
    joined = left.join(right, ["k", PART], "left")
    assert Counter(map(tuple, joined.select("id", "k", "v").collect())) == Counter(
        map(tuple, rows.join(lookup, "k", "left").select("id", "k", "v").collect()))
    largest = left.groupBy("k", PART).count().agg({"count": "max"}).first()[0]
    assert largest < 250
    assert left.join(right, ["k", PART], "left_anti").count() == rows.join(lookup, "k", "left_anti").count()


def test_small_groups_are_left_alone(spark):
    rows = spark.range(1000).selectExpr("id", "0 AS k")
    assert hot_keys(rows, ["k"]).count() == 0 and hot_keys(rows.limit(0), ["k"], 1).count() == 0


SPLIT_EARLY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def early(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT_EARLY}
    for k, v in SPLIT_EARLY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_claim_made_by_most_narratives_is_split(early):
    """One figure and one URL of one report fill most of the claims; Spark splits their partitions."""
    narratives = early.range(0, 60000, 1, 16).selectExpr(
        "id AS narrative_id", "IF(id % 4 > 0, 0, id) AS report_id", "'Foram 12 casos, ver http://x.br/a' AS narrative", "0 AS retry_count")
    news = early.range(0, 60000, 8).selectExpr("id AS report_id", "id AS pos", "'t' AS title", "IF(id > 0, '12 casos', '13 casos') AS snippet",
                                               "IF(id > 0, 'http://x.br/a/', 'http://x.br/b') AS url")
    metrics = early.createDataFrame([], "report_id bigint, metric_key string, component string, value double, computable boolean, "
                                    "numerator bigint, denominator bigint, period string")
    for found in (g.numeric_mismatches(narratives, metrics, news), g.source_mismatches(narratives, news)):
        rows = found.collect()
        assert len(rows) == sum(1 for i in range(60000) if i % 4 or i == 0 or i % 8)
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
