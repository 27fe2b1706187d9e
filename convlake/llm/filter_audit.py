"""Filter interaction audit: what each filter of a chain removes in every order, from sorted posting lists of failing ids.

Each part's documents are cut into ranges of ids. A range keeps one sorted posting list for each filter, of the documents that fail it, and
one each for good and toxic documents. Unions of lists are k-way merges, differences two-way ones, both galloping: a cursor skips to the
next bound by doubling steps and a binary search. Sizes add up over ranges, so a part of any size is spread over as many tasks as it has
ranges, and what is summed is 80 rows a range: for each set of earlier filters and each next filter, how many the next one removes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import SPACE_CHARS, partitions, store

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Documents of one range, at most: bounds a task's memory.
RANGE_DOCS = 1 << 16
POSTINGS = "part string, first_id long, last_id long, docs long, ids array<long>, fails array<array<int>>, good array<int>, toxic array<int>"
SIZES = "part string, mask int, filter int, docs long, before long, removed long, good_lost long, toxic_lost long"


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A (1) too few words, B (2) repeated words, C (4) capitals, D (8) signs."""
    stripped = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.split(stripped, r"[\x20\x09-\x0D]+", -1)
    n = F.when(stripped == "", 0).otherwise(F.size(words))
    few = n < MIN_WORDS
    repeated = (stripped != "") & (100 * F.size(F.array_distinct(words)) < 50 * n)
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long")
    bits = [few, repeated, capitals, text.rlike(r"[#$%&*|]")]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, doc_id, fails, good, toxic): one row per document, fails with the bit 16 for a text that a smaller id has, too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = store(rows.select("part", "doc_id", text_failures(F.col("text")).alias("fails"), F.unhex(F.sha2("text", 256)).alias("sha")), "audit-flags")
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # joins are by ids, never by texts, so copies of one text are spread like all other rows
    known = known.join(first, ["doc_id", "sha"], "left").join(marks, "doc_id", "left")
    known = known.select("part", "doc_id", F.when(F.col("first"), F.col("fails")).otherwise(F.col("fails") + 16).alias("fails"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return known.unionByName(rows.where("doc_id IS NULL").select("part", "doc_id", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def posting_lists(rows: DataFrame, filters: int = len(FILTERS), range_docs: int = RANGE_DOCS) -> DataFrame:
    """One row per range of ids of a part: its ids in order, and for each filter, for good and for toxic documents the sorted places in ids."""
    rows = store(rows, "audit-rows")  # sampled for the ranges, then read again

    def lists(part: str, ids: list, fails: list, good: list, toxic: list) -> tuple:
        held = [[at for at, f in enumerate(fails) if f >> i & 1] for i in range(filters)]
        some = [i for i in ids if i is not None]
        return part, min(some, default=None), max(some, default=None), len(ids), ids, held, [at for at, x in enumerate(good) if x], [at for at, x in enumerate(toxic) if x]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["part", "first_id", "last_id", "docs", "ids", "fails", "good", "toxic"]
        part, held = None, ([], [], [], [])

        def batch_of(row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for p, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] and (p != part or len(held[0]) >= range_docs):
                    yield batch_of(lists(part, *held))
                    held = ([], [], [], [])
                part = p
                for column, value in zip(held, values):
                    column.append(value)
        if held[0]:
            yield batch_of(lists(part, *held))

    n = partitions(rows.sparkSession)
    ranged = rows.select("part", "doc_id", "fails", "good", "toxic").repartitionByRange(n, "part", "doc_id").sortWithinPartitions("part", "doc_id", "fails", "good", "toxic")
    return ranged.mapInArrow(run, POSTINGS)


def gallop(items: list[int], at: int, bound: int) -> int:
    """The first place from at on whose item is not below bound."""
    step, low = 1, at
    while at < len(items) and items[at] < bound:
        low, at, step = at + 1, at + step, 2 * step
    return bisect_left(items, bound, low, min(at, len(items)))


def union(lists: list[list[int]]) -> list[int]:
    """The sorted union of sorted lists without repeats: the list with the smallest head gives all it has below the next smallest head."""
    heads = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapify(heads)
    out: list[int] = []
    while heads:
        head, i, at = heads[0]
        if len(heads) == 1:
            out += lists[i][at:]
            return out
        bound = min(heads[1][0], heads[2][0]) if len(heads) > 2 else heads[1][0]
        to = gallop(lists[i], at, bound) if head < bound else at + 1
        if head < bound:
            out += lists[i][at:to]
        if to < len(lists[i]):
            heapreplace(heads, (lists[i][to], i, to))
        else:
            heappop(heads)
    return out


def difference(items: list[int], gone: list[int]) -> list[int]:
    """The items that are not in gone; both are sorted."""
    out: list[int] = []
    at = skip = 0
    while at < len(items):
        skip = gallop(gone, skip, items[at])
        if skip == len(gone):
            return out + items[at:]
        to = gallop(items, at, gone[skip])
        out += items[at:to]
        at = to + (to < len(items) and items[to] == gone[skip])
    return out


def range_sizes(fails: list[list[int]], good: list[int], toxic: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(mask of earlier filters, next filter, removed before, removed by it, good and toxic ones of these)."""
    for mask in range(1 << len(fails)):
        before = union([x for i, x in enumerate(fails) if mask >> i & 1])
        for i, own in enumerate(fails):
            if not mask >> i & 1:
                removed = difference(own, before)
                yield mask, i, len(before), len(removed), len(removed) - len(difference(removed, good)), len(removed) - len(difference(removed, toxic))


def set_sizes(postings: DataFrame) -> DataFrame:
    """(part, mask, filter, docs, before, removed, good_lost, toxic_lost), summed over the part's ranges."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in SIZES.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32()] + [pa.int64()] * 5
        for batch in batches:
            for row in batch.to_pylist():
                out = [(row["part"], mask, i, row["docs"], *sizes) for mask, i, *sizes in range_sizes(row["fails"], row["good"], row["toxic"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    sizes = postings.select("part", "docs", "fails", "good", "toxic").mapInArrow(run, SIZES)
    return sizes.groupBy("part", "mask", "filter").agg(*(F.sum(c).alias(c) for c in ("docs", "before", "removed", "good_lost", "toxic_lost")))


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, mask, filter): every step of every order."""
    rows = [("".join(filters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(len(filters))) for k in range(len(filters))]
    return spark.createDataFrame(rows, "filter_order string, step int, mask int, filter int")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", range_docs: int = RANGE_DOCS) -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text counts as empty (it fails A, and E if a smaller id is empty too), null part as the empty string. Every row is a document: rows
    that repeat an id are counted each, and none of them is a copy of the other, as no id is smaller; a row without id never fails E, makes
    no other fail it and has no label. A document is good or toxic if any of its label rows says so. Equal texts are found by their SHA-256.
    Other columns are not read. An empty table gives no rows.
    """
    n = len(FILTERS)
    postings = store(posting_lists(flagged(docs, labels, id_col, text_col, part_col), n, range_docs), "audit-postings")
    sizes = store(set_sizes(postings), "audit-sizes")
    # the number of orders in which exactly the filters of mask come before the filter
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("mask") + 1)
    own = sizes.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("mask") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.bit_count("mask") == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(weight * F.col("removed")).alias("shapley"),
    )
    rows = sizes.join(F.broadcast(orders(docs.sparkSession)), ["mask", "filter"]).join(own, ["part", "filter"])  # orders: 600 rows
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def duckdb_sql() -> str:
    """The same rows from failure sets, for every order."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part,
    (len(w) < {MIN_WORDS})::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT AS c,
    regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS e
  FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, a, b, c, d, e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), s AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, good, toxic, n, a + b + c + d + e AS failing,
         CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1 AS fails,
         least(CASE WHEN a = 1 THEN instr(filter_order, 'A') END, CASE WHEN b = 1 THEN instr(filter_order, 'B') END, CASE WHEN c = 1 THEN instr(filter_order, 'C') END,
               CASE WHEN d = 1 THEN instr(filter_order, 'D') END, CASE WHEN e = 1 THEN instr(filter_order, 'E') END) AS removed_at
  FROM m, (VALUES {orders}) o(filter_order), range(1, 6) r(step)
), counted AS (
  SELECT part, filter_order, step::INT AS step, filter,
    sum(n) FILTER (removed_at IS NULL OR removed_at > step) AS kept,
    sum(n) FILTER (removed_at = step) AS removed,
    sum(n) FILTER (fails AND removed_at < step) AS redundant,
    sum(n) FILTER (fails AND failing = 1) AS unique_fails,
    sum(n) FILTER (removed_at = step AND good = 1) AS good_lost,
    sum(n) FILTER (removed_at = step AND toxic = 1) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM counted
"""
