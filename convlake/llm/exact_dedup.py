"""Exact dedup by content sort: texts are range-partitioned by sampled splitters, sorted, and compared with their neighbours in full.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import one_space, partitions, store

#: Characters of the text that lead the sort key. Splitters are sampled from the key, so they stay short however long the texts are.
SPLITTER_CHARS = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space is one space. The row with the smallest id stays.

    The sort key is (first characters, 64-bit hash, piece), the comparison is over the whole text. A text held by more rows than half a
    partition's share is dealt over several pieces, each of which finds its own smallest id; the heads of the pieces, at most four for
    each partition, are then compared with each other. So no task gets more than its share, whatever the largest group is.

    Null text counts as empty, and empty texts are equal to each other. A null id sorts after all others. Of rows that repeat both id and
    text exactly one is kept. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), one_space(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.select("doc_id", "norm", F.xxhash64("norm").alias("h"))
    share = max(1, -(-docs.count() // (2 * partitions(spark))))
    # At most 2 x partitions hashes occur more often than that, so this side is bounded and safe to broadcast.
    hot = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > share)
    hot = hot.select("h", F.ceil(F.col("n") / share).cast("long").alias("pieces"))

    dealt = rows.join(F.broadcast(hot), "h", "left").select(
        F.substring("norm", 1, SPLITTER_CHARS).alias("lead"),
        "h",
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).alias("piece"),
        F.col("pieces").isNotNull().alias("hot"),
        "doc_id",
        "norm",
    )
    run = Window.partitionBy("lead", "h", "piece", "norm")  # met by the range partitioning: no second exchange
    first = run.orderBy(F.col("doc_id").asc_nulls_last())
    runs = store(
        dealt.repartitionByRange("lead", "h", "piece")
        .select(
            "*",
            F.first("doc_id").over(first).alias("head_id"),
            F.row_number().over(first).alias("at"),
            F.count("*").over(run).alias("n"),
        )
        .select(
            "doc_id", "h", "piece", "hot", "head_id", "at", "n",
            F.sha2("norm", 256).alias("text_sha256"),
            F.when(F.col("hot") & (F.col("at") == 1), F.col("norm")).alias("head_text"),
        ),
        "content-runs",
    )

    whole = Window.partitionBy("h", "head_text")
    order = whole.orderBy(F.col("head_id").asc_nulls_last(), "piece")
    heads = runs.where(F.col("hot") & (F.col("at") == 1)).select(
        F.col("h").alias("g_h"),
        F.col("piece").alias("g_piece"),
        F.col("head_id").alias("g_head"),
        F.first("head_id").over(order).alias("g_keep"),
        F.sum("n").over(whole).alias("g_n"),
        (F.row_number().over(order) == 1).alias("g_first"),
    )
    same = (F.col("h") == F.col("g_h")) & (F.col("piece") == F.col("g_piece")) & F.col("head_id").eqNullSafe(F.col("g_head")) & F.col("hot")
    return runs.join(F.broadcast(heads), same, "left").select(
        "doc_id",
        F.when(F.col("hot"), F.col("g_keep")).otherwise(F.col("head_id")).alias("keep_id"),
        F.coalesce("g_n", "n").alias("group_size"),
        ((F.col("at") == 1) & F.coalesce("g_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )
