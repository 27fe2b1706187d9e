"""What users mark in their messages: pins, which stay in view, and exchanges to be thrown away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import disposable, estimate_tokens, pinned

# How much of a message the view shows, and of how many of a conversation's.
DROP_CHARS, USER_CHARS, LAST_USERS = 300, 240, 200


def scan_marks(messages: DataFrame, pins: DataFrame, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks in users' messages (conv, idx, role, content) that are not held yet: pins (conv, idx, text) and drops (conv, idx).

    A text pinned twice in a message is one pin; a pin that was switched off is held too, so scanning again adds nothing. Null contents
    hold no mark.
    """
    users = messages.where("role = 'user' AND content IS NOT NULL")
    new = users.select("conv", "idx", F.explode(pinned(F.col("content"))).alias("text")).distinct().join(pins, ["conv", "idx", "text"], "left_anti")
    return new, users.where(disposable(F.col("content"))).select("conv", "idx").distinct().join(drops, ["conv", "idx"], "left_anti")


def exchanges(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Marks on any message (conv, idx) as marks on the exchange that holds it: user_idx, the last user's message at or before it; where a
    conversation has none before it, there is no row. As-of by a running maximum over both, without a range join."""
    rows = messages.where("role = 'user'").select("conv", "idx", F.col("idx").alias("user"), F.lit(0).alias("_asked")).unionByName(asked.select("conv", "idx", F.lit(1).alias("_asked")), allowMissingColumns=True)
    w = Window.partitionBy("conv").orderBy("idx", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("user_idx", F.max("user").over(w)).where("_asked = 1 AND user_idx IS NOT NULL").select("conv", "idx", "user_idx")


def apply_actions(pins: DataFrame, actions: DataFrame) -> DataFrame:
    """pins (conv, id, idx, text, active) after actions (conv, id, seq, action, text): unpin switches off, update_pin replaces the text by
    one that is not blank; the last of each counts. Actions on other ids change nothing."""
    texts = F.when((F.col("action") == "update_pin") & (F.btrim(F.regexp_replace("text", r"\s+", " ")) != ""), F.struct("seq", F.btrim("text").alias("text")))
    last = actions.groupBy("conv", "id").agg(F.max(texts)["text"].alias("new_text"), F.coalesce(F.bool_or(F.col("action") == "unpin"), F.lit(False)).alias("off"))
    changed = pins.join(last, ["conv", "id"], "left")
    return changed.select("conv", "id", "idx", F.coalesce("new_text", "text").alias("text"), (F.col("active") & ~F.coalesce("off", F.lit(False))).alias("active"))


def marks_view(messages: DataFrame, pins: DataFrame, drops: DataFrame, most_tokens: int) -> DataFrame:
    """One row for each conversation of messages: conv, pins (idx, text, active, in order), pin_tokens of the active ones, over_limit, drops
    (idx, head of the message), users (idx, head; the last 200). Texts are cut inside the rows before anything is gathered."""
    users = messages.where("role = 'user'").select("conv", "idx", "content")
    head = lambda n: F.substring(F.coalesce("content", F.lit("")), 1, n)
    newest = Window.partitionBy("conv").orderBy(F.desc("idx"))
    gathered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    latest = users.select("conv", "idx", head(USER_CHARS).alias("text")).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= LAST_USERS).groupBy("conv").agg(gathered("idx", "text").alias("users"))
    dropped = drops.select("conv", "idx").distinct().join(users, ["conv", "idx"], "left").select("conv", "idx", head(DROP_CHARS).alias("text")).groupBy("conv").agg(gathered("idx", "text").alias("drops"))
    used = F.sum(F.when(F.col("active"), estimate_tokens(F.col("text"))).otherwise(0))
    pinned_rows = pins.groupBy("conv").agg(gathered("idx", "text", "active").alias("pins"), used.alias("pin_tokens"))
    rows = messages.select("conv").distinct().join(pinned_rows, "conv", "left").join(dropped, "conv", "left").join(latest, "conv", "left").withColumn("pin_tokens", F.coalesce("pin_tokens", F.lit(0).cast("long")))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("conv", none("pins"), "pin_tokens", (F.col("pin_tokens") > most_tokens).alias("over_limit"), none("drops"), none("users"))
