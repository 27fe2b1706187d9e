"""The registered recall queries where the message that they ask for is not in the archive."""

import duckdb
import pytest

from convlake.operators.recall import Recall
from convlake.plans.registry import QUERIES, SQL
from tests.test_queries import SF, plain


@pytest.fixture(scope="module")
def missing(spark, tmp_path_factory):
    """The smallest tables without conversation 3's third message."""
    d = str(tmp_path_factory.mktemp("missing"))
    for t, where in (("conversations", "conv_id <> 3 OR turn <> 2"), ("events", "TRUE")):
        spark.read.parquet(f"{SF}/{t}.parquet").where(where).write.parquet(f"{d}/{t}.parquet")
    return d


def both(spark, d, name):
    c = duckdb.connect()
    for t in ("conversations", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    theirs = c.execute(SQL[name])
    names = [x[0] for x in theirs.description]
    ours = [[plain(r[n]) for n in names] for r in QUERIES[name](spark, d).collect()]
    return sorted(map(repr, ours)), sorted(repr([plain(v) for v in r]) for r in theirs.fetchall())


def test_an_id_that_is_not_there(spark, missing):
    ours, theirs = both(spark, missing, "rc01_recall_id")
    assert ours == theirs == []


def test_around_a_message_that_is_not_there(spark, missing):
    ours, theirs = both(spark, missing, "rc01_recall_neighbors")
    assert ours == theirs and len(ours) == 4


def test_places_of_the_recall_function(spark):
    pieces = [(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (1, 2, "c"), (1, 9, "d"), (2, 1, "e")]
    rows = spark.createDataFrame([(*p, "user", p[2], 1) for p in pieces], "conv long, idx int, rid string, role string, content string, tokens long")
    none = spark.createDataFrame([], "conv long, idx int, op string, path string, failed boolean, command string")
    Recall(rows, none, spark.createDataFrame([], "conv long, cut_idx int"), "placed").register()
    found = lambda args: [r.rid for r in spark.sql(f"SELECT * FROM placed({args})").orderBy("place").collect()]
    assert found("conv => 1, first => 6, mode => 'neighbors', near => 3") == ["c"]
    assert found("conv => 1, first => 6, mode => 'neighbors', near => 4") == ["b", "b", "c", "d"]
    assert found("conv => 1, first => 6, mode => 'siblings'") == [] and found("conv => 1, first => 10, mode => 'siblings'") == ["d"]
    assert found("first => 2, mode => 'neighbors'") == found("conv => 1, first => 2") == found("conv => 1, mode => 'neighbors'") == []
    assert found("id => 'z', conv => 1, first => 2, mode => 'neighbors'") == []
    assert found("id => 'b', mode => 'neighbors'") == ["a", "b", "b", "c"]  # each piece once, also around copies
    plan = spark.sql("SELECT * FROM placed(conv => 1, first => 2, mode => 'neighbors')")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
