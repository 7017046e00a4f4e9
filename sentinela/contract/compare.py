"""Run one registered query next to its SQL and report the differences."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def differences(spark_df, con, sql: str, show: int = 3) -> tuple[int, list[str]]:
    """Row count and differences; none when both sides hold the same columns, types and rows, in any order."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    ours = spark_df.columns
    if sorted(ours) != sorted(names):
        return 0, [f"columns {sorted(ours)} against {sorted(names)}"]
    order = sorted(ours)
    want = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    have = Counter(tuple(_plain(r[c]) for c in order) for r in spark_df.collect())
    found = []
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
    for name, kind in spark_df.dtypes:
        if kinds.get(kind) != types[name]:
            found.append(f"type of {name}: {kind} against {types[name]}")
    missing, extra = want - have, have - want
    if missing or extra:
        found.append(f"{sum(have.values())} rows against {sum(want.values())}; {sum(extra.values())} differ, {order}")
        found += [f"  ours {r}" for r in list(extra)[:show]] + [f"  SQL  {r}" for r in list(missing)[:show]]
    return sum(have.values()), found
