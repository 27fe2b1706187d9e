"""Corpus pipeline: reject documents of low quality, drop repeated lines, keep one of each group of near copies, pack the rest.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever others there are and
whatever they are called. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm import line_dedup as lines
from convlake.llm import ngram_join, packing
from convlake.llm import quality as classifier
from convlake.llm.common import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold, with the model fitted on the documents that come in.

    A null text is scored as an empty one; repeated rows get the same score each; where no document has a label, all have the same score.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents hold stay in the last of them only. n_chars follows the text.

    A row that loses nothing stays as it is, a null text included. Rows without id are smaller than all others, rows that share one are one
    document.
    """
    out = lines.line_dedup(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join (five-word shingles, Jaccard similarity 0.8 or more) the one with the smallest id stays.

    Texts without words link with nothing and stay, null ones included, as do rows without id. Rows that share an id stay or go together.
    """
    found = ngram_join.ngram_jaccard_join(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Neither the classifier nor token ids can be stated in SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
