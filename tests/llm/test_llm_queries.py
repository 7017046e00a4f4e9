import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sentinela.contract.compare import differences, duckdb_connection
from sentinela.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")


def test_all_are_registered():
    names = entry.queries()
    assert [n for n in queries.QUERIES if n not in names] == [] and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    rows, found = differences(queries.QUERIES[name](spark, SMALL), duckdb_connection(SMALL), queries.ORACLES[name])
    assert rows > 0 and not found, "\n".join(found)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [{r.doc_id for r in docs.select("doc_id").collect()}]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL))
        assert name == "packing" or docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").collect()}
    assert len(bad & kept[1]) <= 0.2 * len(bad) and len(good & kept[1]) >= 0.95 * len(good)
    assert len(kept[2]) < len(kept[1]) and kept[3] == kept[2] == kept[4] == kept[5]
    assert sum(r.length for r in docs.collect()) == docs.agg({"length": "sum"}).first()[0] > 0


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0
