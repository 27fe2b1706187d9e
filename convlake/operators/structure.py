"""Links between pieces: segments, turns, neighbours, calls and outputs, files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that may begin with each other are brought together by their first 2^5, 2^6, ... characters.
HEAD = 32


def visible(df: DataFrame, current: DataFrame, max_idx: Column | int, key: str = "rid") -> DataFrame:
    """Rows before max_idx, or of the request in progress."""
    marked = current.select(key).distinct().withColumn("in_chain", F.lit(True))
    return df.join(marked, key, "left").where((F.col("idx") < max_idx) | F.col("in_chain")).drop("in_chain")


def segment_of(df: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """seg: the number of cuts (keys, cut_idx) at or before each row; as-of by a running count over both, without a range join."""
    rows = df.withColumn("_cut", F.lit(0)).unionByName(cuts.select(*keys, F.col("cut_idx").cast(df.schema["idx"].dataType).alias("idx"), F.lit(1).alias("_cut")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("idx", F.col("_cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seg", F.sum("_cut").over(w)).where("_cut = 0").drop("_cut")


def turn_of(df: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    """turn_idx: the idx of the last row that starts a turn, at or before each row."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("turn_idx", F.last(F.when(starts, F.col("idx")), ignorenulls=True).over(w))


def neighbors(df: DataFrame, around: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rows at most n places from those of `around` (keys, idx): an equi-join on the 2n + 1 places of each, not a range join."""
    places = around.select(*keys, F.col("idx").alias("of_idx"), F.explode(F.sequence(F.col("idx") - n, F.col("idx") + n)).alias("idx"))
    return df.join(places, [*keys, "idx"])


def nth_after(df: DataFrame, keys: list[str], opens: Column, follows: Column) -> DataFrame:
    """Positional links: each following row with the row that opens its run, and its number (from 1) in the run."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("opened_by", F.last(F.when(opens, F.col("idx")), ignorenulls=True).over(w)).where(follows & F.col("opened_by").isNotNull())
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "opened_by").orderBy("idx")))


def first_message(df: DataFrame, keys: list[str], role: str) -> DataFrame:
    return df.where(F.col("role") == role).groupBy(*keys).agg(F.min_by("content", "idx").alias("first_text"))


def last_call_wins(calls: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs with the latest earlier call of the same key."""
    latest = calls.groupBy(*keys).agg(F.max_by(F.struct(*calls.columns), "idx").alias("call"))
    return outputs.join(latest, keys).where(F.col("call.idx") < F.col("idx"))


def rereads(ops: DataFrame) -> DataFrame:
    """Reads of a path that an earlier operation of the conversation touched, with the gap and that operation."""
    w = Window.partitionBy("conv", "path").orderBy("idx")
    return ops.withColumn("prev_idx", F.lag("idx").over(w)).withColumn("prev_op", F.lag("op").over(w)).where((F.col("op") == "read") & F.col("prev_idx").isNotNull()).withColumn("gap", F.col("idx") - F.col("prev_idx"))


def islands(df: DataFrame, keys: list[str], order: list, border: Column) -> DataFrame:
    """island: numbers runs of rows; a row where border holds begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.coalesce(border, F.lit(False)).cast("int")).over(w))


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching half-open spans (a, b)."""
    w = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    rows = islands(spans.withColumn("reach", F.max("b").over(w)), keys, ["a", "b"], F.col("a") > F.col("reach"))
    return rows.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def covered(spans: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that lie inside one merged span of `by`: the last merged span that begins at or before each, found by a running maximum."""
    merged = merged_spans(by, keys).select(*keys, "a", "b", F.lit(0).alias("_own"))
    rows = merged.unionByName(spans.withColumn("_own", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("a", "_own").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.last(F.when(F.col("_own") == 0, F.col("b")), ignorenulls=True).over(w)
    return rows.withColumn("_reach", reach).where("_own = 1 AND b <= _reach").drop("_own", "_reach")


def prefix_hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, n, h): the hash of a text's first n characters, for the lengths n at which it may begin with another text, its own among them.

    Texts are hashed, in one running pass, at the lengths n of texts that are shorter than HEAD or have the same first 2^k characters,
    2^k <= n < 2^(k+1). Empty texts have none.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, text, F.length(text).alias("n")).where("n > 0")
    short = rows.where(F.col("n") < HEAD).agg(F.collect_set("n").alias("short"))
    powers = F.filter(F.array(*(F.lit(2**k) for k in range(5, 31))), lambda p: p <= F.col("n"))
    heads = rows.where(F.col("n") >= HEAD).select(key, "n", F.explode(F.transform(powers, lambda p: F.struct(p.alias("p"), F.xxhash64(F.substring(F.col(text), F.lit(1), p)).alias("x")))).alias("head"))
    # a text alone with its beginning has no prefix of these lengths
    lengths = heads.groupBy("head").agg(F.collect_set(F.when(F.col("n") < 2 * F.col("head.p"), F.col("n"))).alias("some"), F.count("*").alias("texts")).where("texts > 1 AND size(some) > 0")
    asked = heads.select(key, "head").join(lengths, "head").groupBy(key).agg(F.flatten(F.collect_list("some")).alias("lengths"))

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        for batch in batches:
            out = []
            for k, t, some, few in zip(batch[key], batch[text], batch["lengths"], batch["short"]):
                running, at = hashlib.sha256(), 0
                for n in sorted([*few, *(some if some is not None else ())]):
                    if n > len(t):
                        break
                    running.update(t[at:n].encode())
                    at = n
                    out.append((k, n, running.digest()))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["k", "n", "h"])
                    out = []
            yield pd.DataFrame(out, columns=["k", "n", "h"])

    # one row of fewer than HEAD lengths
    asked = rows.where(F.col(key).isNotNull()).select(key, text).join(asked, key, "left").crossJoin(F.broadcast(short)).select(key, text, "lengths", "short")
    return asked.mapInPandas(run, f"k {kind}, n int, h binary")


def saved_prefixes(df: DataFrame, key: str, text: str) -> DataFrame:
    """The longest text of a smaller key that a text begins with, all of it: key, longest, saved (the smallest key of that text).

    Empty texts are no prefix; texts without a saved prefix have no row.
    """
    saved = df.where(F.length(text) > 0).groupBy(F.length(text).alias("n"), F.unhex(F.sha2(text, 256)).alias("h")).agg(F.min(key).alias("saved"))
    return prefix_hashes(df, key, text).join(saved, ["n", "h"]).where("saved < k").groupBy(F.col("k").alias(key)).agg(F.max("n").alias("longest"), F.max_by("saved", "n").alias("saved"))


def superseded(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with which one of a larger key begins, all of it: key, superseded_by (the largest such key). Empty texts are never superseded."""
    newest = prefix_hashes(df, key, text).groupBy("n", "h").agg(F.max("k").alias("superseded_by"))
    own = df.where(F.length(text) > 0).select(key, F.length(text).alias("n"), F.unhex(F.sha2(text, 256)).alias("h"))
    return own.join(newest, ["n", "h"]).where(F.col(key) < F.col("superseded_by")).select(key, "superseded_by")
