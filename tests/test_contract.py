"""Every registered query against its SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from sentinela.contract.compare import differences, duckdb_connection
from sentinela.contract.oracles import ORACLES
from sentinela.contract.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SMALL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_but_the_file_listing_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"source_files"}
    assert not set(ORACLES) - set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    rows, found = differences(QUERIES[name](spark, SMALL), con, ORACLES[name])
    assert rows > 0 and not found, "\n".join(found)


def test_no_query_takes_part_of_a_table():
    """Only the five items of a search are a limit; see `top_news`."""
    package = os.path.join(os.path.dirname(entry.__file__), "sentinela")
    for folder in ("contract", "operators", "plans", "functions"):
        for name in os.listdir(os.path.join(package, folder)):
            if name.endswith(".py") and name != "oracles.py":
                source = open(os.path.join(package, folder, name)).read()
                assert not re.search(r"\bLIMIT\b|\.limit\(|substr\(text|TABLESAMPLE|rank [<=]|MAX_NEWS_ITEMS", source), name
