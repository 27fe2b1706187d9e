"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from convlake.plans import archive_queries, bench_queries, coverage_queries, import_queries, leaf_queries, mark_queries, operation_queries, owner_queries, recall_queries, search_queries, table_function_queries  # noqa: F401
from convlake.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v if not isinstance(v, int) else float(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert len(df.columns) == len(set(df.columns)) and rows
        return
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    theirs = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in result.fetchall())
    assert ours == theirs
