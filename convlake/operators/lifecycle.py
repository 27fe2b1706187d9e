"""Writes and reads of stored tables: inserts, upserts, deletions, content-addressed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one of the latest version."""
    latest = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return old.unionByName(new).withColumn("_at", F.row_number().over(latest)).where("_at = 1").drop("_at")


def latest_versions(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def delete_conversation(tables: dict[str, DataFrame], conv: Column | int | str, column: str = "conv") -> dict[str, DataFrame]:
    """Every table that has the conversation column without that conversation's rows; the others as they are."""
    return {name: df.where(~F.col(column).eqNullSafe(conv)) if column in df.columns else df for name, df in tables.items()}


def inventory(tables: dict[str, DataFrame], column: str = "conv") -> DataFrame:
    """table, conv, rows, bytes over all tables that have the conversation column."""
    out = None
    for name, df in tables.items():
        if column not in df.columns:
            continue
        size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
        part = df.groupBy(F.col(column).alias("conv")).agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes")).select(F.lit(name).alias("table_name"), "conv", "n_rows", "n_bytes")
        out = part if out is None else out.unionByName(part)
    return out


def fixed_blocks(df: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """Blocks of `size` characters of each text, by content: key, pos, n, hash."""
    n = F.length(content)
    rows = df.select(key, F.col(content).alias("_text"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / size).cast("int") - 1))).alias("pos")).where(F.length("_text") > 0)
    return rows.withColumn("block", F.substring("_text", F.col("pos") * size + 1, F.lit(size))).select(key, "pos", F.length("block").alias("n"), F.sha2("block", 256).alias("hash"))


def refcounts(blocks: DataFrame) -> DataFrame:
    """How often each block is referred to; a repeated block counts every time."""
    return blocks.groupBy("hash").agg(F.count("*").alias("refs"), F.max("n").alias("n"))


def garbage(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    return stored.join(referenced.select("hash"), "hash", "left_anti")


def content_dedup(df: DataFrame, key: str, content: str) -> DataFrame:
    """hash, first, n, others: equal texts (after trimming) with the smallest key and how many there are besides."""
    return df.groupBy(F.sha1(F.btrim(F.coalesce(F.col(content), F.lit("")))).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("n"))
