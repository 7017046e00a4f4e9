"""Column profiles of files put together, and settings that jobs need."""

import random

import pytest

from sentinela.operators import profiles as p
from sentinela.operators import quality as q
from sentinela.session import work_folder
from sentinela.sources import news as n

SCHEMA = "file int, age string, name string, empty string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(rng.randrange(5), rng.choice([str(rng.randrange(2000)), f"{rng.randrange(90)}.5", "NA", "", None, "x"]), f"n{rng.randrange(9000)}", None) for _ in range(20_000)]
    return [*out, (7, "3", "only", None)]


def exact(rows, i):
    values = [r[i] for r in rows if r[i] not in (None, "", "NA")]
    numbers = sorted(float(v) for v in values if v not in ("x",) and not v.startswith(("n", "o")))
    return len(rows), len(rows) - len(values), min(values, default=None), max(values, default=None), len(set(values)), numbers


def test_merged_profiles_are_those_of_the_whole(spark, rows):
    raw = spark.createDataFrame(rows, SCHEMA)
    parts = p.column_profiles(raw, "ISO-8859-1", ["file"])
    assert parts.count() == 6 * 3
    merged = {r.column: r for r in p.described(p.merge_profiles(parts)).collect()}
    whole = {r.column: r for r in p.described(p.column_profiles(raw.drop("file"), "UTF-8")).collect()}
    for i, column in enumerate(["age", "name", "empty"], 1):
        n_rows, missing, least, greatest, distinct, numbers = exact(rows, i)
        for r in (merged[column], whole[column]):
            assert (r.rows, r.missing, r.least, r.greatest, r.numbers) == (n_rows, missing, least, greatest, len(numbers))
            assert abs(r.distinct - distinct) <= p.DISTINCT_ERROR * distinct
            if numbers:
                for share, value in zip((0.25, 0.5, 0.75), r.quantiles, strict=True):
                    below, upto = (sum(f(x, value) for x in numbers) / len(numbers) for f in (float.__lt__, float.__le__))
                    assert below - 2 * p.RANK_ERROR <= share <= upto + 2 * p.RANK_ERROR
            else:
                assert r.quantiles is None
    assert {r.encodings for r in merged.values()} == {"ISO-8859-1"} and {r.encoding for r in whole.values()} == {"UTF-8"}


def test_profiles_of_one_file_after_another(spark, rows):
    """Merging merged profiles, and those of a file of its own encoding."""
    raw = spark.createDataFrame(rows, SCHEMA)
    first = p.merge_profiles(p.column_profiles(raw.filter("file < 3"), "UTF-8", ["file"])).withColumnRenamed("encodings", "encoding")
    second = p.column_profiles(raw.filter("file >= 3").drop("file"), "ISO-8859-1")
    both = {r.column: r for r in p.described(p.merge_profiles(first.unionByName(second))).collect()}
    assert both["name"].rows == len(rows) and both["name"].encodings == "ISO-8859-1,UTF-8"
    assert abs(both["name"].distinct - exact(rows, 2)[4]) <= p.DISTINCT_ERROR * exact(rows, 2)[4]


def test_no_rows(spark, rows):
    got = p.described(p.column_profiles(spark.createDataFrame([], SCHEMA), "UTF-8")).collect()
    assert len(got) == 4 and all((r.rows, r.missing, r.least, r.distinct, r.numbers, r.quantiles) == (0, 0, None, 0, 0, None) for r in got)


def test_the_log_names_the_encoding(spark):
    log = {(r.section, r.name): r.status for r in q.exclusion_log(spark.createDataFrame([("1",)], "UTI string"), "UTF-8").collect()}
    assert log["input", "encoding"] == "UTF-8" and log["input", "rows"] == "1"
    assert ("input", "encoding") not in {(r.section, r.name) for r in q.exclusion_log(spark.createDataFrame([("1",)], "UTI string")).collect()}


def test_news_need_a_setting_and_change_none(spark):
    responses = spark.createDataFrame([(1, '{"results": [{"title": "a", "title": "b"}]}')], "report_id int, response string")
    before = spark.conf.get(n.DUPLICATE_KEYS)
    assert n.extract_news(responses).first().title == "b"
    try:
        spark.conf.set(n.DUPLICATE_KEYS, "false")
        with pytest.raises(ValueError, match="allowDuplicateKeys"):
            n.extract_news(responses)
        assert spark.conf.get(n.DUPLICATE_KEYS) == "false"
    finally:
        spark.conf.set(n.DUPLICATE_KEYS, before)


class Session:
    """A session with a master and, perhaps, the setting."""

    def __init__(self, master, folder=None):
        settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: settings})()


def test_work_folders_lie_where_the_cluster_says():
    one, two = (work_folder(Session("spark://m:7077", "hdfs://shared/x/")) for _ in range(2))
    assert one != two and one.startswith("hdfs://shared/x/") and "//" not in one.removeprefix("hdfs://")
    assert work_folder(Session("local[4]")) != work_folder(Session("local"))
    for master in ("spark://m:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            work_folder(Session(master))
