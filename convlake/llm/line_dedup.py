"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm.common import discard, fold_ascii, partitions, scratch_root, store, strip_ascii

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return strip_ascii(fold_ascii(line))


def _hash(key: Column) -> Column:
    """128 bits of a key, as two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, no_id, row_hash, pos): each line whose key has at least min_chars code points. row_hash tells rows that share an id
    apart, and no_id is a number of its own for each row without id."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    keys = F.transform(F.split(fold_ascii(body), "\n", -1), lambda line, pos: F.struct(strip_ascii(line).alias("key"), pos.alias("pos")))
    no_id = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = docs.select(F.col(id_col).alias("doc_id"), no_id.alias("no_id"), F.xxhash64(body).alias("row_hash"), F.explode(F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)).alias("line"))
    return rows.select(_hash(F.col("line.key")).alias("h"), "doc_id", "no_id", "row_hash", "line.pos").select("h.h1", "h.h2", "doc_id", "no_id", "row_hash", "pos")


class LineRuns:
    """Runs of (h1, h2, n_docs, keeper), sorted by hash in buckets of hashes, in levels.

    Batches come in descending ranges of ids. A batch is aggregated and merge-anti-joined with the runs there are: what is left are keys
    that no later document holds, and their keeper is the largest id that holds them in this batch. Keys seen before add to the count only.
    Both become one run of level 0. As soon as a level holds `fanout` runs they are merged into one run of the next level, so n batches
    leave about fanout x log(n) runs and every row is rewritten log(n) times.

    All runs are tables with the same buckets, so the anti-joins move no row between tasks. Merging runs reads their files and exchanges
    them once. Runs are written, so a lost executor never costs an earlier batch.
    """

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.places: dict[DataFrame, tuple[str, str]] = {}

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _written(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark)}/{name}"
        writer = rows.repartition(self.buckets, *self.KEY).write.bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY)
        writer.option("path", path).format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        self.places[run] = name, path
        return run

    def _drop(self, runs: list[DataFrame]) -> None:
        for r in runs:
            name, path = self.places.pop(r)
            discard(self.spark.read.schema(r.schema).parquet(path))
            self.spark.sql(f"DROP TABLE {name}")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = self.spark.read.schema(runs[0].schema).parquet(*(self.places[r][1] for r in runs))
        return union.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows of hashes (h1, h2, ...) whose key no run holds: a merge-anti-join."""
        for r in self.runs():
            hashes = hashes.join(r.select(*self.KEY), list(self.KEY), "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch of (h1, h2, doc_id, no_id, ...), all of whose ids are below those of earlier batches; the batch without ids comes last."""
        held = hashes.select(*self.KEY, "doc_id", "no_id").distinct().groupBy(*self.KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if not self.runs():
            return self._put(0, self._written(held.withColumnRenamed("max_doc", "keeper")))
        batch = self._written(held)
        fresh = self.unseen(batch).withColumnRenamed("max_doc", "keeper")
        again = batch.join(fresh.select(*self.KEY), list(self.KEY), "left_anti").select(*self.KEY, "n_docs", F.lit(None).cast(held.schema["max_doc"].dataType).alias("keeper"))
        run = self._written(fresh.unionByName(again))
        self._drop([batch])
        return self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._written(self._merged(old)))
            self._drop(old)

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) over all batches: the number of documents that hold a key, and the largest id among them."""
        return self._merged(self.runs())

    def close(self) -> None:
        """Deletes the runs; nothing that reads them may be evaluated any more."""
        self._drop(self.runs())
        self.levels = []


def dropped_lines(hashes: DataFrame, runs: LineRuns, min_docs: int = MIN_DOCS) -> DataFrame:
    """(drop_id, drop_row, gone): for each row that loses lines, their places in order.

    Keys that many documents hold are split from the rest: at most one for each partition occurs more often than a partition's share of
    rows, so those are broadcast and their rows are never shuffled by key.
    """
    share = max(1, -(-hashes.count() // partitions(hashes.sparkSession)))
    frequent = store(runs.totals().where(F.col("n_docs") >= min_docs), "frequent-lines")
    hot = frequent.where(F.col("n_docs") > share).select("h1", "h2", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot"))
    tagged = hashes.join(F.broadcast(hot), ["h1", "h2"], "left")
    cold = tagged.where(F.col("hot").isNull()).drop("hot_keeper", "hot").join(frequent.where(F.col("n_docs") <= share), ["h1", "h2"])
    row = ["doc_id", "row_hash", "pos"]
    held = tagged.where("hot").select(*row, F.col("hot_keeper").alias("keeper")).unionByName(cold.select(*row, "keeper"))
    lost = held.where(F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper"))))
    return lost.groupBy(F.col("doc_id").alias("drop_id"), F.col("row_hash").alias("drop_row")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 3) -> DataFrame:
    """One row per input row: row (a struct with all columns of docs), kept_text, n_lines, n_dropped.

    Lines are cut at \\n (null or empty text: one empty line). A key is the line without ASCII white space at its ends, with A-Z in lower
    case. Keys of at least min_chars code points that at least min_docs documents hold lose all their lines, except in the document with
    the largest id that holds them. Batches are ranges of ids, the largest first.

    Rows that share an id are one document: they count once and keep or lose a line together. A row without id counts as a document whose
    id is smaller than every other; where only such rows hold a key, nothing is dropped. Columns of any name pass through inside `row`. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    hashes = store(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    cuts = sorted(set(hashes.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    runs, i = LineRuns(spark, fanout), F.col("doc_id")
    for k in reversed(range(len(cuts) + 1)):
        low = F.lit(True) if k == 0 else i > cuts[k - 1]
        high = F.lit(True) if k == len(cuts) else i <= cuts[k]
        runs.add(hashes.where((low & high) | (i.isNull() if k == 0 else F.lit(False))))
    drop = dropped_lines(hashes, runs, min_docs)
    runs.close()

    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key_id"), F.xxhash64(body).alias("key_row"), body.alias("body"))
    out = rows.join(drop, F.col("key_id").eqNullSafe(F.col("drop_id")) & (F.col("key_row") == F.col("drop_row")), "left")
    lines = F.split("body", "\n", -1)
    out = out.select("row", "body", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNotNull(), lines).alias("lines"), "gone")
    edges = F.concat(F.array(F.lit(-1)), "gone", F.array(F.col("n_lines").cast("int")))
    out = out.select("row", "body", "n_lines", "lines", "gone", edges.alias("edges"))
    between = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", F.get("edges", k) + 2, F.get("edges", k + 1) - F.get("edges", k) - 1))
    return out.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.flatten(between), "\n")).alias("kept_text"),
        "n_lines",
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def unseen_lines(docs: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """For a stream of batches: (h1, h2, doc_id) of the keys that no earlier batch held, with the smallest id that brings each."""
    new = runs.unseen(line_hashes(docs, id_col, text_col, min_chars))
    return new.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
