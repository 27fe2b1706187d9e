"""Recall as a table function of SQL: one call for ids, files, one query or several, composed lazily over the archive's views.

    Recall(pieces, operations, cuts).register()
    SELECT * FROM recall(query => 'port of the database', ord => 'time', roles => array('tool'), conv => 7)

Which branch runs follows from the arguments, which are constants, so the optimizer drops the others with all that they would read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.text import BASE, MARKED, STOP_WORDS
from convlake.operators.search import B, FUSION_K, K1, LEAST_IDF, passages
from convlake.operators.structure import segment_of

#: Characters shown before and behind a passage, results shown, queries and terms of one that count.
PAD, SHOWN, QUERIES, TERMS = 160, 8, 6, 16
ROLES = {"reasoning": "assistant-reasoning", "args": "assistant-tool-args", "output": "tool", "answer": "assistant"}

HEADER = "place INT, rid STRING, conv {conv}, message INT, seg BIGINT, role STRING, tool STRING, file STRING, command STRING, tokens BIGINT, first_char INT, last_char INT, n_chars INT, strong BOOLEAN, score DOUBLE, same_text_in ARRAY<INT>, text STRING"
_HEAD = "rid, conv, message, seg, role, tool, file, command, tokens"


def _fold(text: str) -> str:
    return f"translate(lower({text}), '{MARKED}', '{BASE}')"


class Recall:
    """pieces: conv, idx, rid, role, content, tokens. operations: conv, idx, op, path, failed, and command where there is one. cuts: conv,
    cut_idx, one row for each segment but the first. Messages are counted from 1, segments from 0."""

    def __init__(self, pieces: DataFrame, operations: DataFrame, cuts: DataFrame, name: str = "recall"):
        self.spark, self.name = pieces.sparkSession, name
        self.conv = pieces.schema["conv"].dataType.simpleString()
        command = F.col("command") if "command" in operations.columns else F.lit(None).cast("string")
        last = operations.groupBy("conv", "idx").agg(F.max_by(F.struct(F.col("op").alias("tool"), F.col("path").alias("file"), command.alias("command")), "path").alias("op"))
        self.heads = segment_of(pieces, cuts, ["conv"]).join(last.withColumn("of_tool", F.lit("tool")), ["conv", "idx"], "left").select(
            "conv", "idx", "rid", "role", "content", "tokens", "seg", (F.col("idx") + 1).cast("int").alias("message"),
            *(F.when(F.col("role") == F.col("of_tool"), F.col(f"op.{c}")).alias(c) for c in ("tool", "file", "command")),
        )
        self.operations = operations.withColumn("command", command)

    def register(self) -> None:
        """Makes the views and the function of this session."""
        n = self.name
        self.heads.createOrReplaceTempView(f"{n}_heads")
        self.operations.createOrReplaceTempView(f"{n}_operations")
        passages(self.heads.select("conv", "idx", "rid", F.coalesce("content", F.lit("")).alias("content"))).drop("content").createOrReplaceTempView(f"{n}_passages")
        arguments = f"id STRING DEFAULT NULL, path STRING DEFAULT NULL, query STRING DEFAULT NULL, queries ARRAY<STRING> DEFAULT NULL, mode STRING DEFAULT NULL, ord STRING DEFAULT 'relevance', roles ARRAY<STRING> DEFAULT NULL, in_seg BIGINT DEFAULT NULL, first INT DEFAULT NULL, last INT DEFAULT NULL, conv {self.conv} DEFAULT NULL, near INT DEFAULT 2"
        branches = " UNION ALL ".join((self._by_id(), self._around(), self._file(), self._search()))
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {n}({arguments}) RETURNS TABLE ({HEADER.format(conv=self.conv)}) RETURN {branches}")

    def _whole(self, place: str) -> str:
        return f"SELECT CAST({place} AS INT) AS place, {', '.join('h.' + c for c in _HEAD.split(', '))}, 0, length(h.content), length(h.content), CAST(NULL AS BOOLEAN), CAST(NULL AS DOUBLE), CAST(NULL AS ARRAY<INT>), h.content"

    @property
    def _id(self) -> str:
        return f"regexp_replace(trim({self.name}.id), '^(recall:|id=)', '')"

    def _by_id(self) -> str:
        return f"{self._whole('1')} FROM {self.name}_heads h WHERE h.rid = {self._id} AND {self.name}.mode IS NULL AND (h.conv = {self.name}.conv OR {self.name}.conv IS NULL)"

    def _around(self) -> str:
        """Pieces up to `near` (1 to 6) messages away, or of the same message: an equi-join on the places. Without an id, around message `first`
        of `conv`, whether or not a piece of it is there."""
        n = self.name
        nothing_else = " AND ".join(f"{n}.{a} IS NULL" for a in ("id", "path", "query", "queries"))
        reach = f"CASE WHEN {n}.mode = 'siblings' THEN 0 ELSE least(6, greatest(1, {n}.near)) END"
        place = "row_number() OVER (PARTITION BY h.conv ORDER BY h.idx, h.rid)"
        return f"""{self._whole(place)} FROM {n}_heads h LEFT SEMI JOIN (SELECT c, explode(sequence(i - r, i + r)) AS at FROM
            (SELECT o.conv AS c, o.idx AS i, {reach} AS r FROM {n}_heads o WHERE o.rid = {self._id} UNION ALL SELECT {n}.conv, {n}.first - 1, {reach} WHERE {nothing_else} AND {n}.first IS NOT NULL)
            WHERE {n}.mode IN ('neighbors', 'siblings')) a ON h.conv = a.c AND h.idx = a.at"""

    def _file(self) -> str:
        """Operations on a path, or on one that ends with the other, in order; mode 'first': the first write of each conversation."""
        n = self.name
        hit = f"(o.path = {n}.path OR endswith(o.path, concat('/', {n}.path)) OR endswith({n}.path, concat('/', o.path)))"
        return f"""SELECT CAST(place AS INT), rid, conv, message, seg, role, op, path, command, tokens, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), first_write, CAST(NULL AS DOUBLE), CAST(NULL AS ARRAY<INT>), text FROM (
              SELECT o.conv, CAST(o.idx + 1 AS INT) AS message, o.op, o.path, o.command, h.rid, h.seg, h.role, h.tokens,
                     o.op = 'write' AND row_number() OVER (PARTITION BY o.conv, o.path, o.op ORDER BY o.idx) = 1 AS first_write,
                     row_number() OVER (PARTITION BY o.conv ORDER BY o.idx) AS place, CASE WHEN o.failed THEN 'failed' ELSE 'done' END AS text
              FROM {n}_operations o LEFT JOIN {n}_heads h ON h.conv = o.conv AND h.idx = o.idx
              WHERE {n}.id IS NULL AND {hit} AND (o.conv = {n}.conv OR {n}.conv IS NULL)) WHERE first_write OR coalesce({n}.mode, 'timeline') <> 'first'"""

    def _search(self) -> str:
        """BM25 of passages for each query, the best passage of each piece, ranks fused, equal excerpts once; the statistics are those of all
        passages. Strong: all words in one passage. By time: the oldest of the strong ones first, then of the others."""
        n, stop = self.name, ", ".join(f"'{w}'" for w in STOP_WORDS)
        toks = lambda x: f"regexp_extract_all({_fold(x)}, '[\\\\p{{L}}\\\\p{{N}}]+', 0)"
        long = f"filter(array_distinct({toks('q')}), w -> length(w) > 1)"
        asked = f"slice(array_distinct(filter(concat(array({n}.query), coalesce({n}.queries, array())), q -> trim(coalesce(q, '')) <> '')), 1, {QUERIES})"
        wanted = f"transform({asked}, q -> slice(CASE WHEN size(filter({long}, w -> NOT w IN ({stop}))) > 0 THEN filter({long}, w -> NOT w IN ({stop})) ELSE {long} END, 1, {TERMS}))"
        role = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())
        hits = f"""SELECT * FROM (SELECT t.rid, t.conv, t.idx, t.off, t.len, t.dl, g.n, g.avgdl, qn, size(words) AS n_terms, term, size(filter(toks, x -> x = term)) AS f
            FROM (SELECT p.rid, p.conv, p.idx, p.off, p.len, {toks('p.passage')} AS toks, size({toks('p.passage')}) AS dl, {wanted} AS wanted FROM {n}_passages p WHERE {n}.id IS NULL AND {n}.path IS NULL AND ({n}.query IS NOT NULL OR {n}.queries IS NOT NULL)) t
            JOIN (SELECT count(*) AS n, avg(size({toks('p.passage')})) AS avgdl FROM {n}_passages p) g
            LATERAL VIEW posexplode(t.wanted) AS qn, words LATERAL VIEW explode(words) AS term) WHERE f > 0"""
        return f"""SELECT * FROM (WITH hits AS ({hits}) SELECT CAST(row_number() OVER (PARTITION BY one ORDER BY CASE WHEN by_time THEN message END, chosen) AS INT), {_HEAD}, a, b, n_chars, strong, score, same_text_in, text FROM (
          SELECT *, row_number() OVER (PARTITION BY one ORDER BY NOT strong, CASE WHEN by_time THEN message END, score DESC, message, conv, rid) AS chosen FROM (
            SELECT *, row_number() OVER (PARTITION BY sha1(trim(text)) ORDER BY NOT strong, CASE WHEN by_time THEN message END, score DESC, message, conv, rid) AS copy,
                   array_sort(array_except(collect_set(message) OVER (PARTITION BY sha1(trim(text))), array(message))) AS same_text_in FROM (
              SELECT f.*, {', '.join('h.' + c for c in _HEAD.split(', ') if c != 'rid')}, 1 AS one, {n}.ord = 'time' AS by_time, length(h.content) AS n_chars,
                     CAST(greatest(0, f.off - {PAD}) AS INT) AS a, CAST(least(length(h.content), f.off + f.len + {PAD}) AS INT) AS b,
                     substring(h.content, CAST(greatest(0, f.off - {PAD}) AS INT) + 1, CAST(f.off + f.len + {PAD} - greatest(0, f.off - {PAD}) AS INT)) AS text
              FROM (SELECT rid, round(sum(1.0D / ({FUSION_K} + rank)), 9) AS score, bool_or(full) AS strong, min_by(struct(off, len), struct(NOT full, qn)).off AS off, min_by(struct(off, len), struct(NOT full, qn)).len AS len FROM (
                SELECT *, row_number() OVER (PARTITION BY qn ORDER BY full DESC, bm DESC, idx, conv, rid) - 1 AS rank FROM (
                  SELECT *, row_number() OVER (PARTITION BY qn, rid ORDER BY full DESC, bm DESC, off) AS best FROM (
                    SELECT s.qn, s.rid, s.conv, s.idx, s.off, s.len, round(sum(greatest(ln((s.n - d.df + 0.5D) / (d.df + 0.5D)), {LEAST_IDF}) * s.f * {K1 + 1} / (s.f + {K1} * ({1 - B} + {B} * s.dl / s.avgdl))), 9) AS bm, count(*) = max(s.n_terms) AS full
                    FROM hits s JOIN (SELECT qn, term, count(*) AS df FROM hits GROUP BY qn, term) d ON d.qn = s.qn AND d.term = s.term
                    GROUP BY s.qn, s.rid, s.conv, s.idx, s.off, s.len)) WHERE best = 1) GROUP BY rid) f
              JOIN {n}_heads h ON h.rid = f.rid
              WHERE (h.conv = {n}.conv OR {n}.conv IS NULL) AND (h.seg = {n}.in_seg OR {n}.in_seg IS NULL) AND (h.message >= {n}.first OR {n}.first IS NULL) AND (h.message <= {n}.last OR {n}.last IS NULL)
                AND ({n}.roles IS NULL OR array_contains(transform({n}.roles, r -> CASE lower(trim(r)) {role} ELSE lower(trim(r)) END), h.role)))) WHERE copy = 1) WHERE chosen <= {SHOWN})"""
