"""The recall function's arguments beyond those of the registered queries."""

import pytest
from pyspark.sql import functions as F

from convlake.operators.recall import Recall

PIECES = [
    (1, 0, "a", "user", "What is the port of the database?", 9), (1, 1, "b", "tool", "port: 5432\nhost: db", 6), (1, 2, "c", "assistant", "The database listens on port 5432.", 10),
    (1, 3, "d", "user", None, 0), (1, 4, "e", "tool", "port: 5432\nhost: db", 6), (2, 0, "f", "user", "x " * 2000 + "port database " + "y " * 2000, 2300), (2, 1, "g", "assistant", "", 0),
]


@pytest.fixture(scope="module")
def recall(spark):
    pieces = spark.createDataFrame(PIECES, "conv long, idx int, rid string, role string, content string, tokens long")
    ops = spark.createDataFrame([(1, 1, "read", "src/db.yaml", False, "cat"), (1, 4, "write", "src/db.yaml", True, None), (2, 9, "write", "db.yaml", False, None), (2, 10, "write", "xdb.yaml", False, None)], "conv long, idx int, op string, path string, failed boolean, command string")
    Recall(pieces, ops, spark.createDataFrame([(1, 2)], "conv long, cut_idx int"), "recalled").register()
    return lambda args: sorted(spark.sql(f"SELECT * FROM recalled({args})").collect(), key=lambda r: (r.place, r.conv))


def test_headers_of_an_id(recall):
    (row,) = recall("id => ' id=b'")
    assert row.asDict() == dict(place=1, rid="b", conv=1, message=2, seg=0, role="tool", tool="read", file="src/db.yaml", command="cat", tokens=6, first_char=0, last_char=19, n_chars=19, strong=None, score=None, same_text_in=None, text="port: 5432\nhost: db")
    assert recall("id => 'b', conv => 2") == [] and recall("id => 'nowhere'") == [] and recall("") == []
    assert [(r.rid, r.seg) for r in recall("id => 'c', mode => 'neighbors', near => 99")] == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 1)]
    assert [r.rid for r in recall("id => 'c', mode => 'siblings'")] == ["c"]


def test_files(recall):
    assert [(r.conv, r.message, r.tool, r.strong, r.text) for r in recall("path => 'db.yaml'")] == [(1, 2, "read", False, "done"), (2, 10, "write", True, "done"), (1, 5, "write", True, "failed")]
    assert [(r.conv, r.rid) for r in recall("path => 'src/db.yaml', mode => 'first', conv => 1")] == [(1, "e")]
    assert recall("path => 'b.yaml'") == []


def test_queries(recall):
    found = recall("query => 'the PORT, database'")
    assert [r.rid for r in found][:3] and {r.rid for r in found} == {"a", "b", "c", "f"} and [r.strong for r in found] == [True, True, True, False]
    copy = next(r for r in found if r.rid == "b")
    assert copy.same_text_in == [5] and copy.text == PIECES[1][4]
    long = next(r for r in found if r.rid == "f")
    assert "port database" in long.text and (long.first_char, long.last_char) == (3690, 4710) and len(long.text) == 1020 and long.n_chars == len(PIECES[5][4])
    assert [r.rid for r in recall("query => 'port database', ord => 'time', conv => 1")] == ["a", "b", "c"]
    assert [r.rid for r in recall("query => 'port', roles => array(' OUTPUT ')")] == ["b"] and [r.rid for r in recall("query => 'port', first => 2, last => 3, conv => 1")] == ["b", "c"]
    assert {r.rid for r in recall("query => 'port', in_seg => 1, conv => 1")} == {"c", "e"}
    assert {r.rid for r in recall("query => 'the', conv => 1")} == {"a", "c"}  # nothing but stop words
    assert recall("query => 'zebra'") == [] and recall("queries => array('', NULL)") == []


def test_other_branches_are_not_read(spark, recall):
    plan = spark.sql("SELECT * FROM recalled(id => 'b')")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "recalled_passages" not in plan
    assert "regexp_extract_all" in spark.sql("SELECT * FROM recalled(query => 'b')")._jdf.queryExecution().optimizedPlan().toString()
