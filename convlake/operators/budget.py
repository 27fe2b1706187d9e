"""Token budgets: running sums, greedy choices, masks and cuts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import CHARS_PER_TOKEN

#: Rows of a group that may still fit behind the first that does not, up to which they are folded in one row.
MANY = 100_000


def prefix_offsets(df: DataFrame, keys: list[str], order: list, size: str = "tokens", start: int = 0) -> DataFrame:
    """offset: the sizes of all earlier rows, from start."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)) + start)


def suffix_totals(df: DataFrame, keys: list[str], order: list, size: str = "tokens") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("tail", F.sum(size).over(w))


def take_until_overflow(df: DataFrame, keys: list[str], order: list, budget: int, size: str = "tokens") -> DataFrame:
    """Rows in order up to the first that does not fit; what comes after it is left out even if it would fit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def take_what_fits(df: DataFrame, keys: list[str], order: list, budget: int, size: str = "tokens", item: str = "rid", most: int | None = None, many: int = MANY) -> DataFrame:
    """keys, item: rows in order, passing over each that does not fit or comes when `most` are taken already. A null size is 0, as is a negative one.

    Rows up to the first that does not fit are a running sum. Of the others only those count that are no larger than the room that is left
    then, as it can only shrink: these few are folded in order inside their group's row. A group with more than `many` of them passes
    through a task in order instead, which holds nothing but a running total.
    """
    group = Window.partitionBy(*keys)
    rows = df.select(*keys, item, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_at"))
    ordered = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("_used") <= budget if most is None else (F.col("_used") <= budget) & (F.col("_at") <= most)
    rows = rows.withColumn("_used", F.sum("_size").over(ordered)).withColumn("_fits", fits)
    rows = rows.withColumn("_room", budget - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_used"))).over(group), F.lit(0))).withColumn("_left", F.lit(most) - F.count_if("_fits").over(group))
    may = ~F.col("_fits") & (F.col("_size") <= F.col("_room")) & F.coalesce(F.col("_left") > 0, F.lit(True))
    rows = rows.withColumn("_may", may).withColumn("_n", F.count_if("_may").over(group))
    head = rows.where("_fits").select(*keys, item)
    found = rows.where(F.col("_may") & (F.col("_n") <= many)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_size", item))).alias("_rows"), F.first("_room").alias("_room"), F.first("_left").alias("_left"))
    start = F.struct(F.col("_room").alias("room"), F.array().cast(f"array<{df.schema[item].dataType.simpleString()}>").alias("taken"))

    def step(state, row):
        more = row["_size"] <= state["room"]
        if most is not None:
            more = more & (F.size(state["taken"]) < F.col("_left"))
        return F.when(more, F.struct((state["room"] - row["_size"]).alias("room"), F.concat(state["taken"], F.array(row[item])).alias("taken"))).otherwise(state)

    folded = found.select(*keys, F.explode(F.aggregate("_rows", start, step)["taken"]).alias(item))
    return head.unionByName(folded).unionByName(_streamed(rows.where(F.col("_may") & (F.col("_n") > many)), keys, item))


def _streamed(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The same of groups of any size: a task passes a group's rows in order and holds its running total."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_at").select(*keys, item, "_size", "_room", F.coalesce("_left", F.lit(1 << 62)).alias("_left"))

    def run(batches: Iterator) -> Iterator:
        group, used, n = None, 0, 0
        for batch in batches:
            taken = []
            names = batch[keys].astype(object).where(batch[keys].notna(), None)
            for key, one, room, left in zip(names.itertuples(index=False, name=None), batch["_size"].tolist(), batch["_room"].tolist(), batch["_left"].tolist()):
                if key != group:
                    group, used, n = key, 0, 0
                fits = used + one <= room and n < left
                used, n = used + one * fits, n + fits
                taken.append(fits)
            yield batch[taken].drop(columns=["_size", "_room", "_left"])

    return rows.mapInPandas(run, rows.drop("_size", "_room", "_left").schema)


def oldest_until(df: DataFrame, keys: list[str], order: list, target: Column, saving: str = "saving", least: int = 0) -> DataFrame:
    """Rows in order until their savings reach target; none where all of them save less than `least`."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chosen = df.withColumn("saved_before", F.coalesce(F.sum(saving).over(before), F.lit(0))).where(F.col("saved_before") < target)
    return chosen.withColumn("saved", F.sum(saving).over(Window.partitionBy(*keys))).where(F.col("saved") >= least)


def largest_until_fit(df: DataFrame, keys: list[str], size: str, tie: list, excess: Column) -> DataFrame:
    """The fewest of the largest rows whose sizes cover the excess; none of a group that cannot cover it."""
    order = [F.col(size).desc(), *tie]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("freed_before", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("all", F.sum(size).over(Window.partitionBy(*keys)))
    return rows.where((excess > 0) & (F.col("all") >= excess) & (F.col("freed_before") < excess)).drop("all")


def text_within(text: Column, cap: Column | int) -> Column:
    """The longest prefix whose estimated tokens are at most cap."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    longest = F.ceil((cap + 0.5) * CHARS_PER_TOKEN).cast("int") - 1
    return F.substring(text, F.lit(1), F.greatest(F.lit(0), longest))


def age_in_turns(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """age: assistant messages from this row on, itself included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("age", F.sum((F.col("role") == "assistant").cast("int")).over(w))


def protected_tail(df: DataFrame, keys: list[str], newest_first: list, keep: int, size: str = "tokens") -> DataFrame:
    """protected: the newest rows until their tokens pass `keep`, the row that passes it included."""
    w = Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("protected", F.coalesce(F.sum(size).over(w), F.lit(0)) <= keep)


def mask_candidates(df: DataFrame, keys: list[str], keep: int, least_tokens: int, least_age: int, receipt_tokens: int) -> DataFrame:
    """Pieces that may be hidden, with the tokens that hiding one saves."""
    rows = protected_tail(age_in_turns(df, keys, ["idx"]), keys, [F.col("idx").desc()], keep)
    free = rows.where((F.col("tokens") >= least_tokens) & (F.col("age") >= least_age) & ~F.col("protected") & (F.col("role") == "assistant"))
    return free.withColumn("saving", F.col("tokens") - receipt_tokens).where("saving > 0")


def segment_cut(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Where to cut each conversation: its first human message whose tail fits, else the first message after a change of speaker whose tail fits, else its last."""
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = suffix_totals(df, keys, ["idx"]).withColumn("before", F.lag("role").over(w)).where("idx > 0")
    fits = F.col("tail") <= most
    human = F.min(F.when(fits & (F.col("role") == "user"), F.col("idx")))
    border = F.min(F.when(fits & (F.col("role") == "assistant") & F.col("before").isin("user", "tool"), F.col("idx")))
    return rows.groupBy(*keys).agg(F.coalesce(human, border, F.max("idx")).alias("cut"), F.max(F.struct("idx", "tail"))["tail"].alias("last_tail"))


def calibrated_scale(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, n_accepted, scale: an ordered fold over (estimated, real). A task passes a group's samples in order and holds one state.

    Samples of at most 1,000 estimated tokens or with a ratio outside 0.25 to 4 are passed over. pending is multiplied by 0.7 + 0.3 x ratio and kept
    within 0.5 and 2; the scale may only rise until 5 samples are accepted, then it is pending.
    """
    rows = samples.select(*keys, order, F.col("estimated").cast("double").alias("_e"), F.col("real").cast("double").alias("_r")).repartition(*keys).sortWithinPartitions(*keys, order)
    schema = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys) + ", n_accepted int, scale double"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        key, state, done = None, None, []
        for batch in batches:
            names = batch[keys].astype(object).where(batch[keys].notna(), None)
            for own, e, r in zip(names.itertuples(index=False, name=None), batch["_e"].tolist(), batch["_r"].tolist()):
                if own != key or state is None:
                    if state is not None:
                        done.append((*key, state[2], round(state[1], 9)))
                    key, state = own, (1.0, 1.0, 0)
                if e > 1000 and 0.25 <= r / e <= 4:  # a null is no number and passes neither
                    pending, n = max(0.5, min(2.0, state[0] * (0.7 + 0.3 * (r / e)))), state[2] + 1
                    state = pending, pending if n >= 5 else max(state[1], pending), n
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=[*keys, "n_accepted", "scale"])
                done = []
        if state is not None:
            done.append((*key, state[2], round(state[1], 9)))
        yield pd.DataFrame(done, columns=[*keys, "n_accepted", "scale"])

    return rows.mapInPandas(run, schema)
