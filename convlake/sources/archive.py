"""The archive's tables as DataFrames over the given Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlake.functions.text import estimate_tokens

PIECES = T.StructType(
    [
        T.StructField("conv", T.LongType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("rid", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tokens", T.LongType()),
    ]
)
#: Kinds of events and the file operations that they stand for.
OPERATIONS = {"signup": "write", "purchase": "edit", "view": "read", "click": "bash", "error": "bash"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at path; where there is none, an empty one. Columns that an older table lacks are null."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return found.select(*((F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def with_piece_id(df: DataFrame, *parts: str) -> DataFrame:
    """rid: 'r' and 12 hex digits of the SHA-256 of the parts joined by colons."""
    return df.withColumn("rid", F.concat(F.lit("r"), F.substring(F.sha2(F.concat_ws(":", *(F.col(p).cast("string") for p in parts)), 256), 1, 12)))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message of the conversations: conv, idx, rid, role, content, tokens."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").cast("int").alias("idx"), "role", F.col("text").alias("content"))
    return with_piece_id(rows, "conv", "idx", "content").withColumn("tokens", estimate_tokens(F.col("content"))).select(PIECES.names)


def document_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool outputs of one conversation per source."""
    order = Window.partitionBy("source").orderBy("doc_id")
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("conv"), (F.row_number().over(order) - 1).alias("idx"), F.lit("tool").alias("role"), F.col("text").alias("content"), "doc_id")
    return rows.withColumn("tokens", estimate_tokens(F.col("content")))


def file_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the ledger of file operations: conv, idx, event_id, ts, op, path, failed, value."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    op = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in OPERATIONS.items()))
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv"),
        (F.row_number().over(order) - 1).alias("idx"),
        "event_id", "ts", op.alias("op"),
        F.concat(F.lit("src/file"), k, F.lit(".js")).alias("path"),
        (F.col("event_type") == "error").alias("failed"),
        "value",
    )
