"""What earlier recall results have shown already: sources of results, and results that older ones cover together."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "array<struct<rid:string,offset:int,chars:int,cut:boolean,grouped:boolean,line_set:array<int>,leaf_lines:array<int>>>"


def sources(meta: Column, cut: Column | None = None) -> Column:
    """What each entry of a result's meta (META) shows for certain: kind, rid, a, b, lines.

    span: the characters [a, b) of a record; lines, leaf: lines of it, each once and in order; cut: cut after meta was written, as every
    entry is where `cut` holds; opaque: anything else, an entry without a record among them. A null meta has no sources.
    """
    whole = F.lit(False) if cut is None else F.coalesce(cut, F.lit(False))

    def one(e: Column) -> Column:
        flag = lambda c: F.coalesce(e[c], F.lit(False))
        some = lambda c: F.coalesce(F.size(e[c]) > 0, F.lit(False))
        kind = F.when(F.coalesce(e["rid"], F.lit("")) == "", "opaque").when(whole | flag("cut"), "cut").when(flag("grouped"), "opaque")
        kind = kind.when(e["offset"].isNotNull() & (e["chars"] > 0), "span").when(some("line_set"), "lines").when(some("leaf_lines"), "leaf").otherwise("opaque")
        lines = F.when(kind == "lines", e["line_set"]).when(kind == "leaf", e["leaf_lines"])
        a, b = (F.when(kind == "span", x) for x in (e["offset"], e["offset"] + e["chars"]))
        return F.struct(kind.alias("kind"), e["rid"].alias("rid"), a.alias("a"), b.alias("b"), F.array_sort(F.array_distinct(lines)).alias("lines"))

    return F.transform(F.coalesce(meta, F.array().cast(META)), one)


class Skyline:
    """The spans of a record that lie in no other one: begins and ends both rise, so a step of a cover is one search."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.owners: list[int] = []

    def add(self, a: int, b: int, owner: int) -> None:
        last = bisect_right(self.begins, a) - 1
        if last >= 0 and self.ends[last] >= b:
            return
        start = bisect_left(self.begins, a)
        stop = max(start, bisect_right(self.ends, b))
        self.begins[start:stop], self.ends[start:stop], self.owners[start:stop] = [a], [b], [owner]

    def cover(self, a: int, b: int) -> list[int] | None:
        """Owners of the fewest spans that cover [a, b) together; each begins where the ones before have reached, and reaches furthest."""
        out = []
        while a < b:
            i = bisect_right(self.begins, a) - 1
            if i < 0 or self.ends[i] <= a:
                return None
            out.append(self.owners[i])
            a = self.ends[i]
        return out


def span_covers(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The different spans (keys, rid, a, b) with first_idx, the first result that shows them, and witnesses: the fewest spans of results
    before first_idx that cover them together (of equal reach the longest, then the oldest), null where none do.

    Equal spans are one row before anything moves, so what a record costs is bounded by what can be shown of it. A record is one sorted
    pass; the state is its skyline.
    """
    named = [*keys, "rid"]
    first = spans.groupBy(*named, "a", "b").agg(F.min("idx").alias("first_idx"))
    ordered = first.repartition(*named).sortWithinPartitions(*named, "first_idx", "a", "b")
    kept = [*named, "a", "b", "first_idx"]
    schema = ", ".join(f"`{c}` {first.schema[c].dataType.simpleString()}" for c in kept) + ", witnesses array<bigint>"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        record, line, waiting = None, Skyline(), []
        for batch in batches:
            found = []
            for *name, a, b, idx in batch[kept].itertuples(index=False, name=None):
                if name != record:
                    record, line, waiting = name, Skyline(), []
                if waiting and waiting[0][2] != idx:  # spans of one result do not cover each other
                    for span in waiting:
                        line.add(*span)
                    waiting = []
                found.append(line.cover(a, b))
                waiting.append((a, b, idx))
            yield batch[kept].assign(witnesses=pd.Series(found, dtype=object, index=batch.index))

    return ordered.select(*kept).mapInPandas(run, schema)


def verified_copies(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results (keys, idx, text, sources) that show nothing new: keys, idx, by, witnesses (idx of older results, in order).

    text: an older result has the same text, blank ones apart; its witness is the oldest. cover: each source lies in what older results
    of the keys show of the same record in the same way, all together; a result without sources, or with one that is cut or opaque, never
    does. A span that an older result shows exactly has the oldest such as its witness, others those of `span_covers`; a line has the
    oldest that shows it. Keys and idx are not null, and idx is unique within the keys.
    """
    hashed = results.where(F.btrim(F.regexp_replace("text", r"\s+", " ")) != "").select(*keys, "idx", F.sha2("text", 256).alias("h"))
    oldest = hashed.groupBy(*keys, "h").agg(F.min("idx").alias("witness"), F.count("*").alias("n")).where("n > 1").drop("n")
    by_text = hashed.join(oldest, [*keys, "h"]).where("witness < idx").select(*keys, "idx", F.lit("text").alias("by"), F.array(F.col("witness").cast("long")).alias("witnesses"))

    shown = results.where(F.size("sources") > 0).select(*keys, "idx", F.size("sources").alias("n"), F.posexplode("sources").alias("at", "s")).select(*keys, "idx", "n", "at", "s.*")
    spans = shown.where("kind = 'span'")
    covers = span_covers(spans, keys)
    witnesses = F.when(F.col("idx") > F.col("first_idx"), F.array(F.col("first_idx").cast("long"))).otherwise(F.col("witnesses"))
    whole = spans.join(covers, [*keys, "rid", "a", "b"]).select(*keys, "idx", "n", witnesses.alias("witnesses")).where("witnesses IS NOT NULL")

    lines = shown.where("kind IN ('lines', 'leaf')").select(*keys, "idx", "n", "at", "kind", "rid", F.explode("lines").alias("line"))
    place = [*keys, "kind", "rid", "line"]
    seen = lines.join(lines.groupBy(*place).agg(F.min("idx").alias("first_idx")), place)
    held = seen.groupBy(*keys, "idx", "n", "at").agg(F.collect_set(F.col("first_idx").cast("long")).alias("witnesses"), F.bool_and(F.col("first_idx") < F.col("idx")).alias("all_seen"))
    whole = whole.unionByName(held.where("all_seen").select(*keys, "idx", "n", "witnesses"))

    together = whole.groupBy(*keys, "idx", "n").agg(F.count("*").alias("held"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("witnesses")))).alias("witnesses")).where("held = n")
    by_cover = together.select(*keys, "idx", F.lit("cover").alias("by"), "witnesses")
    return by_text.unionByName(by_cover.join(by_text, [*keys, "idx"], "left_anti"))
