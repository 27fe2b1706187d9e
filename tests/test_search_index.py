"""The stored index against the search that reads all texts."""

import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from convlake.operators import search
from convlake.operators.search_index import SearchIndex
from convlake.sources.archive import archive

SF = "/root/testdata/sf0.001"
WANTED = ["the", "tion", "der", "onou"]


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="spark-index-")


def found(df, *keys):
    return sorted((*(r[k] for k in keys), round(r.score, 9), r.n_terms) for r in df.collect())


@pytest.mark.parametrize("window", [None, 700])
def test_search_equals_a_scan_after_each_append(spark, root, window):
    pieces = archive(spark, SF)
    index = SearchIndex(spark, root, window=window, buckets=5, fanout=3)
    for bound in ("conv < 3", "conv < 9", "conv < 15", "conv < 30", "true"):
        some = pieces.where(bound)
        index.ensure(some)
        texts = search.passages(some) if window else some.withColumn("off", F.lit(0))
        expected = found(search.bm25(texts, WANTED, content="passage" if window else "content"), "rid", "off")
        assert found(index.search(WANTED), "rid", "off") == expected != []
    assert {r.level for r in index.manifest()} >= {1} and sum(r.pieces for r in index.manifest()) == pieces.select("rid").distinct().count()


def test_only_new_pieces_are_read_and_written(spark, root):
    pieces = archive(spark, SF)
    index = SearchIndex(spark, root)
    first = index.ensure(pieces.where("idx < 2"))
    assert first == pieces.where("idx < 2").count() and index.version() == 1
    assert index.not_indexed(pieces).count() == pieces.count() - first
    assert index.ensure(pieces.where("idx < 2")) == 0 and index.version() == 1
    old = {r.segment for r in index.manifest()}
    assert index.ensure(pieces) == pieces.count() - first
    new = [r for r in index.manifest() if r.segment not in old]
    assert len(new) == 1 and new[0].pieces == pieces.count() - first and old < {r.segment for r in index.manifest()}
    again = SearchIndex(spark, root)
    assert again.ensure(pieces) == 0 and again.manifest() == index.manifest()
    with pytest.raises(ValueError):
        SearchIndex(spark, root, window=None)


def test_a_segment_without_a_manifest_does_not_count(spark, root):
    pieces = archive(spark, SF).limit(40).cache()
    index = SearchIndex(spark, root, window=None)
    index._write(index._postings(pieces), 0, pieces)  # a job that died before its commit
    assert index.version() == 0 and index.search(WANTED).collect() == []
    assert index.ensure(pieces) == pieces.count()
    row = tuple(index.manifest()[0])
    with pytest.raises(Exception, match="(?i)exists"):
        index._commit(0, [row])  # another writer's version stays


def test_odd_pieces(spark, root):
    rows = [(1, 0, "a", "user", None), (1, 1, "b", "user", ""), (1, 2, "c", "user", "The the THE"), (None, 3, "d", None, "the x" * 3000), (1, 2, "c", "user", "The the THE"), (2, 0, "e", "tool", "!?")]
    pieces = spark.createDataFrame(rows, "conv long, idx int, rid string, role string, content string")
    index = SearchIndex(spark, root, window=None)
    assert index.ensure(pieces.limit(0)) == 0 and index.search(["the"]).collect() == []
    assert index.ensure(pieces) == 5 and index.manifest()[0].texts == 5
    assert found(index.search(["the", "nowhere"]), "rid") == found(search.bm25(pieces.dropDuplicates(["rid"]), ["the", "nowhere"]), "rid")
    assert [r.rid for r in index.search(["the"], F.col("conv") == 1).collect()] == ["c"]
    assert index.search([]).collect() == [] and index.search(["nowhere"]).collect() == []


def test_a_search_opens_the_files_of_its_terms_only(spark, root):
    index = SearchIndex(spark, root, buckets=16)
    index.ensure(archive(spark, SF))
    hits = index._of_terms("postings", "term string, f int", ["the"])
    assert {f.rsplit("/", 2)[1] for f in hits.inputFiles()} == {f"bucket={zlib.crc32(b'the') % 16}"}
    assert "PushedFilters: [In(term, [the])]" in hits._jdf.queryExecution().toString() or "EqualTo(term,the)" in hits._jdf.queryExecution().toString()
