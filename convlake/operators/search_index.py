"""A stored inverted index for BM25: postings in segments, appended for pieces that are new, with statistics kept as deltas.

Layout below one folder that the driver and all executors share:

    postings/<segment>/bucket=<b>   term, f, dl, conv, rid, idx, role, off, len; sorted by term (and for each text one without term)
    terms/<segment>/bucket=<b>      term, df: how many texts of the segment hold the term
    pieces/<segment>                rid of each piece that the segment indexes
    manifest/<version>              one row per segment: texts and terms in it, and the settings

A version of the manifest is written as a whole or not at all, and only by one writer: its folder must not exist yet. Segments that no
manifest names do not count, so a job that dies half-way leaves nothing to repair and is simply sent again. Searching opens the files of the
buckets of its terms, and of these only the row groups whose range of terms holds them.
"""

from __future__ import annotations

import math
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions.text import terms
from convlake.operators.search import B, K1, LEAST_IDF, STEP, WINDOW, passages

BUCKETS = 32
#: Files that the rows of one bucket may be split over when they are written, so a frequent term is not one task's work.
SPLITS = 4
POSTINGS = "term string, f int, dl int, conv {conv}, rid string, idx int, role string, off int, len int, bucket int"
MANIFEST = "segment string, level int, pieces long, texts long, terms long, window int, step int, buckets int, conv string"


class SearchIndex:
    """window: the length of the passages that are ranked (`step` apart); None ranks whole pieces.

    Pieces are rows (conv, idx, rid, role, content); a null content is an empty one, which has no terms but counts as a text. A rid is indexed once.
    """

    def __init__(self, spark: SparkSession, root: str, window: int | None = WINDOW, step: int = STEP, buckets: int = BUCKETS, fanout: int = 8):
        self.spark, self.root, self.window, self.step, self.buckets, self.fanout = spark, root.rstrip("/"), window, step, buckets, fanout
        self._read: tuple[int, list] = (0, [])
        settings = {(r.window, r.step, r.buckets) for r in self.manifest()}
        if settings - {(window or 0, step, buckets)}:
            raise ValueError(f"the index at {root} was built with (window, step, buckets) {settings}")

    # ------------------------------------------------------------------ manifest
    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version whose write has ended, 0 for none."""
        path, fs = self._path("manifest/*/_SUCCESS")
        return max((int(s.getPath().getParent().getName()) for s in fs.globStatus(path) or []), default=0)

    def manifest(self) -> list:
        version = self.version()
        if version != self._read[0]:
            self._read = version, self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{version}").collect()  # one row per segment, about fanout x log of them
        return self._read[1]

    def _commit(self, version: int, rows: list) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.root}/manifest/{version + 1}")

    # ------------------------------------------------------------------ writing
    def not_indexed(self, pieces: DataFrame) -> DataFrame:
        """The pieces whose rid no segment has."""
        held = self.manifest()
        if not held:
            return pieces
        return pieces.join(self.spark.read.schema("rid string").parquet(*(f"{self.root}/pieces/{r.segment}" for r in held)), "rid", "left_anti").select(*pieces.columns)

    def _postings(self, pieces: DataFrame) -> DataFrame:
        """One row per text and term with its count, and one per text without a term."""
        texts = pieces.select("conv", "rid", "idx", "role", F.coalesce("content", F.lit("")).alias("content"))
        if self.window:
            texts = passages(texts, window=self.window, step=self.step).select("conv", "rid", "idx", "role", "off", "len", F.col("passage").alias("content"))
        else:
            texts = texts.withColumn("off", F.lit(0)).withColumn("len", F.length("content"))
        # a text's terms sorted: where a run of equal ones begins, and how long it is
        texts = texts.withColumn("toks", F.explode(F.array(F.sort_array(terms(F.col("content")))))).withColumn("dl", F.size("toks"))
        tok = F.col("toks")
        starts = F.filter(F.transform(tok, lambda t, i: F.when((i == 0) | (t != F.get(tok, i - 1)), i)), lambda i: i.isNotNull())
        texts = texts.drop("content").withColumn("starts", F.explode(F.array(starts)))
        runs = F.transform("starts", lambda p, k: F.struct(F.get(tok, p).alias("term"), (F.coalesce(F.get(F.col("starts"), k + 1), F.col("dl")) - p).cast("int").alias("f")))
        own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("f")))
        rows = texts.withColumn("run", F.explode(F.concat(own, runs)))
        return self._with_bucket(rows.select("run.term", "run.f", "dl", "conv", "rid", "idx", "role", "off", "len"))

    def _with_bucket(self, postings: DataFrame) -> DataFrame:
        return postings.withColumn("bucket", F.pmod(F.crc32(F.coalesce("term", F.concat("rid", "off"))), F.lit(self.buckets)).cast("int"))

    def _write(self, postings: DataFrame, level: int, pieces: DataFrame) -> tuple:
        segment = uuid.uuid4().hex
        split = F.pmod(F.xxhash64("rid", "off"), F.lit(SPLITS))
        postings.repartition(self.buckets, "bucket", split).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/postings/{segment}")
        written = self.spark.read.schema(POSTINGS.format(conv=pieces.schema["conv"].dataType.simpleString())).parquet(f"{self.root}/postings/{segment}")
        counts = written.where("term IS NOT NULL").groupBy("bucket", "term").agg(F.count("*").alias("df"))
        counts.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/terms/{segment}")
        pieces.select("rid").write.parquet(f"{self.root}/pieces/{segment}")
        first = written.where("term IS NULL").agg(F.count("*").alias("texts"), F.sum("dl").alias("terms")).first()
        n = self.spark.read.schema("rid string").parquet(f"{self.root}/pieces/{segment}").count()
        return segment, level, n, first.texts, first.terms or 0, self.window or 0, self.step, self.buckets, pieces.schema["conv"].dataType.simpleString()

    def ensure(self, pieces: DataFrame) -> int:
        """Indexes the pieces that no segment has yet and returns how many these were; without new ones nothing is written."""
        held, version = self.manifest(), self.version()
        new = self.not_indexed(pieces.select("conv", "idx", "rid", "role", "content")).dropDuplicates(["rid"])
        if new.isEmpty():
            return 0
        row = self._write(self._postings(new), 0, new)
        self._commit(version, [tuple(r) for r in held] + [row])
        self._merge()
        return row[2]

    def _merge(self) -> None:
        """As soon as a level has `fanout` segments, these become one of the next: each posting is rewritten log(n) times."""
        held, version = self.manifest(), self.version()
        for level in sorted({r.level for r in held}):
            same = [r for r in held if r.level == level]
            if len(same) >= self.fanout:
                self._commit(version, [tuple(r) for r in held if r.level != level] + [self._merged(same, level + 1)])
                return self._merge()

    def _merged(self, rows: list, level: int) -> tuple:
        conv = rows[0].conv
        postings = self.spark.read.schema(POSTINGS.format(conv=conv)).parquet(*(f"{self.root}/postings/{r.segment}/bucket={b}" for r in rows for b in self._present("postings", r.segment)))
        pieces = self.spark.read.schema("rid string").parquet(*(f"{self.root}/pieces/{r.segment}" for r in rows)).withColumn("conv", F.lit(None).cast(conv))
        return self._write(self._with_bucket(postings), level, pieces)

    def _present(self, table: str, segment: str) -> list[int]:
        path, fs = self._path(f"{table}/{segment}/bucket=*")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(path) or [] if s.getPath().getName().split("=")[1].isdigit())

    # ------------------------------------------------------------------ searching
    def _of_terms(self, table: str, schema: str, wanted: list[str]) -> DataFrame:
        """The table's rows of the wanted terms: only their buckets' files are opened."""
        buckets = {zlib.crc32(w.encode()) % self.buckets for w in wanted}
        paths = [f"{self.root}/{table}/{r.segment}/bucket={b}" for r in self.manifest() for b in sorted(buckets & set(self._present(table, r.segment)))]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(F.col("term").isin(wanted))

    def statistics(self, wanted: list[str]) -> tuple[int, float, dict[str, int]]:
        """Number of texts, their mean number of terms, and each wanted term's number of texts, over all segments."""
        held = self.manifest()
        n, total = sum(r.texts for r in held), sum(r.terms for r in held)
        df = self._of_terms("terms", "term string, df long", wanted).groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each wanted term
        return n, total / n if n else 0.0, {r.term: r.df for r in df}

    def search(self, wanted: list[str], where: Column | None = None) -> DataFrame:
        """Texts that hold a wanted term: conv, rid, idx, role, off, len, score, n_terms. `where` (of the first six) chooses among hits; the
        statistics are those of all texts."""
        wanted = list(dict.fromkeys(wanted))
        held = self.manifest()
        n, mean, df = self.statistics(wanted)
        idf = {w: max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), LEAST_IDF) for w in wanted if w in df}
        hits = self._of_terms("postings", POSTINGS.format(conv=held[0].conv if held else "long").rsplit(",", 1)[0], wanted)
        if where is not None:
            hits = hits.where(where)
        weight = F.coalesce(*(F.when(F.col("term") == w, F.lit(v)) for w, v in idf.items()), F.lit(0.0))
        part = weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        return hits.groupBy("conv", "rid", "idx", "role", "off", "len").agg(F.sum(part).alias("score"), F.count("*").cast("int").alias("n_terms"))
