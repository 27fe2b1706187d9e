"""Token counts as delta-maintained rollups by source, language and tokenizer version."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm.common import scratch_path
from convlake.llm.tokens import BpeEncoder, vocabulary

KEY = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def bpe_counts(docs: DataFrame, version: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", ranks_file: str | None = None) -> DataFrame:
    """doc_id, source, lang, version, n_tokens by a public byte-level BPE vocabulary; null text has no tokens."""
    ranks_file = ranks_file or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = BpeEncoder(ranks_file)
        for batch in batches:
            counts = [len(bpe.encode(t.as_py() or "")) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").withColumn("version", F.lit(version))


def word_counts(docs: DataFrame, version: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns; tokens are runs of characters other than ASCII white space."""
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "source", "lang", n.alias("n_tokens")).withColumn("version", F.lit(version))


def inserted(counts: DataFrame) -> DataFrame:
    """Signed changes (source, lang, version, docs, tokens) of new documents."""
    return counts.select(*KEY, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from old counts to new ones: a new count, source or language counts as the old row's end and the new row's begin."""
    return deleted(before).unionByName(inserted(after))


class TokenRollup:
    """Additive totals in a folder that all executors share, one table of aggregated changes for each committed batch.

    A batch is aggregated before it is written, and its table appears as a whole under its number or not at all (Spark's write commit), so
    a batch that failed can be sent again, and one that was committed is not counted twice, whoever repeats it. Batches may come in any
    order. compact() folds committed batches into one table, and the numbers that it has folded into a table beside it, so a batch that
    comes late still counts once. Nulls in source or language are keys of their own; rows that repeat an id are documents of their own.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "token-rollup")).rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _done(self) -> list[str]:
        """The names of all complete tables."""
        fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [n for n in names if fs.exists(root.suffix(f"/{n}/_SUCCESS"))]

    def _tables(self) -> tuple[list[str], list[int], int, set[int]]:
        """The tables that count, the numbers of the batches among them, and the last folded table's number (0: none) and its batches."""
        done = self._done()
        turn = max((int(n.removeprefix("folded-")) for n in done if n.startswith("folded-")), default=0)
        folded = {r.batch for r in self.spark.read.parquet(f"{self.root}/numbers-{turn}").collect()} if turn else set()
        later = sorted(b for n in done if n.startswith("batch-") and (b := int(n.removeprefix("batch-"))) not in folded)
        return [f"folded-{turn}"] * (turn > 0) + [f"batch-{b}" for b in later], later, turn, folded

    def committed(self, batch: int) -> bool:
        _, later, _, folded = self._tables()
        return batch in folded or batch in later

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Counts the changes of a batch. False if that number was committed already: nothing is read or written then."""
        if self.committed(batch):
            return False
        changes.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.root}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of all documents there are; keys without documents and tokens are gone."""
        tables, *_ = self._tables()
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/{t}" for t in tables))
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Folds all committed batches into one table. Their numbers are written first and count as soon as the table is complete; older
        tables count until then."""
        tables, later, turn, folded = self._tables()
        if later:
            numbers = self.spark.createDataFrame([(b,) for b in sorted(folded | set(later))], "batch long")
            numbers.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/numbers-{turn + 1}")
            self.totals().write.mode("overwrite").parquet(f"{self.root}/folded-{turn + 1}")
            fs, root = self._fs()
            for t in [*tables, f"numbers-{turn}"]:
                fs.delete(root.suffix(f"/{t}"), True)
