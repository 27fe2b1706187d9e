"""Recall by its table function: by id, around an id, by file, by one query and by several, in both orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.operators.recall import PAD, SHOWN, Recall
from convlake.plans.registry import TERMS, query
from convlake.sources.archive import archive, file_ops

_HEADS = """<archive>, <ops>, heads AS (
  SELECT a.conv, a.idx, a.rid, a.content, a.tokens, a.idx + 1 AS message, (a.idx >= 2)::BIGINT AS seg, CASE WHEN role = 'assistant' AND (a.conv + a.idx) % 2 = 1 THEN 'tool' ELSE role END AS role,
         CASE WHEN role = 'assistant' AND (a.conv + a.idx) % 2 = 1 THEN o.op END AS tool, CASE WHEN role = 'assistant' AND (a.conv + a.idx) % 2 = 1 THEN o.path END AS file, NULL::VARCHAR AS command
  FROM archive a LEFT JOIN ops o ON o.conv = a.conv AND o.idx = a.idx)"""
_HEAD = "rid, conv, message, seg, role, tool, file, command, tokens"
_WHOLE = f"{_HEAD}, 0 AS first_char, length(content)::INT AS last_char, length(content)::INT AS n_chars, NULL::BOOLEAN AS strong, NULL::DOUBLE AS score, '' AS same_text_in, content AS text"
_ID = "(SELECT rid FROM heads WHERE conv = 3 AND idx = 2)"


def _searched(queries: list[list[str]], where: str, by_time: bool) -> str:
    values = ", ".join(f"({i}, '{w}', {len(q)})" for i, q in enumerate(queries) for w in q)
    order = f"NOT strong, {'message, ' if by_time else ''}score DESC, message, conv, rid"
    return f"""WITH {_HEADS}, p AS (SELECT conv, idx, rid, o * 550 AS off, substr(content, o * 550 + 1, 700) AS passage FROM heads, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(content) - 700) / 550.0)) AS BIGINT) + 1)) AS o)),
      t AS (SELECT *, {TERMS.format("passage")} AS toks FROM p), g AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
      h AS (SELECT t.*, qn, term, n_terms, len(list_filter(toks, lambda x: x = term)) AS f, len(toks) AS dl FROM t, (VALUES {values}) v(qn, term, n_terms)),
      d AS (SELECT qn, term, count(*) AS df FROM h WHERE f > 0 GROUP BY ALL),
      s AS (SELECT qn, rid, conv, idx, off, length(passage) AS plen, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm, count(*) = any_value(n_terms) AS full
            FROM h JOIN d USING (qn, term), g WHERE f > 0 GROUP BY qn, rid, conv, idx, off, passage),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qn, rid ORDER BY "full" DESC, bm DESC, off) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY "full" DESC, bm DESC, idx, conv, rid) - 1 AS rank FROM b),
      f AS (SELECT rid, round(sum(1.0::DOUBLE / (30 + rank)), 9) AS score, bool_or("full") AS strong, arg_min(off, (NOT "full")::INT * 100 + qn) AS off, arg_min(plen, (NOT "full")::INT * 100 + qn) AS plen FROM r GROUP BY rid),
      x AS (SELECT {_HEAD}, greatest(0, off - {PAD})::INT AS first_char, least(length(content), off + plen + {PAD})::INT AS last_char, length(content)::INT AS n_chars, strong, score,
                   substr(content, greatest(0, off - {PAD}) + 1, least(length(content), off + plen + {PAD}) - greatest(0, off - {PAD})) AS text FROM f JOIN heads USING (rid) WHERE {where}),
      y AS (SELECT *, row_number() OVER (PARTITION BY trim(text, ' ') ORDER BY {order}) AS copy,
                   array_to_string(list_sort(list_filter(list_distinct(list(message) OVER (PARTITION BY trim(text, ' '))), lambda m: m <> message)), ',') AS same_text_in FROM x),
      z AS (SELECT *, row_number() OVER (ORDER BY {order}) AS chosen FROM y WHERE copy = 1)
    SELECT row_number() OVER (ORDER BY {"message, " if by_time else ""}chosen)::INT AS place, {_HEAD}, first_char, last_char, n_chars, strong, score, same_text_in, text FROM z WHERE chosen <= {SHOWN}"""


def _recall(spark: SparkSession, d: str, arguments: str) -> DataFrame:
    rows = archive(spark, d)
    tool = (F.col("role") == "assistant") & ((F.col("conv") + F.col("idx")) % 2 == 1)
    pieces = rows.withColumn("role", F.when(tool, F.lit("tool")).otherwise(F.col("role")))
    Recall(pieces, file_ops(spark, d), rows.select("conv").distinct().withColumn("cut_idx", F.lit(2))).register()
    found = spark.sql(f"SELECT * FROM recall({arguments})")
    shown = F.coalesce(F.array_join(F.transform("same_text_in", lambda m: m.cast("string")), ","), F.lit(""))
    return found.withColumn("same_text_in", shown)


def _rid(spark: SparkSession, d: str) -> str:
    """The id of a message; where the archive has no such message, the empty one, which no piece has."""
    found = archive(spark, d).where("conv = 3 AND idx = 2").select("rid").first()
    return found.rid if found else ""


@query("rc01_recall_id", f"WITH {_HEADS} SELECT 1 AS place, {_WHOLE} FROM heads WHERE rid = {_ID}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, f"id => 'recall:{_rid(spark, d)}'")


@query("rc01_recall_neighbors", f"WITH {_HEADS} SELECT row_number() OVER (ORDER BY idx)::INT AS place, {_WHOLE} FROM heads WHERE conv = 3 AND idx BETWEEN -1 AND 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    rid = _rid(spark, d)
    around = f"id => '{rid}'" if rid else "conv => 3, first => 3"
    return _recall(spark, d, f"{around}, mode => 'neighbors', near => 3")


_FILE = f"""WITH {_HEADS}, o AS (SELECT o.conv, (o.idx + 1)::INT AS message, op, path, failed, rid, seg, role, tokens, op = 'write' AND row_number() OVER (PARTITION BY o.conv, path, op ORDER BY o.idx) = 1 AS strong,
      row_number() OVER (PARTITION BY o.conv ORDER BY o.idx)::INT AS place FROM ops o LEFT JOIN heads h ON h.conv = o.conv AND h.idx = o.idx WHERE path = 'src/file7.js')
    SELECT place, rid, conv, message, seg, role, op AS tool, path AS file, NULL::VARCHAR AS command, tokens, NULL::INT AS first_char, NULL::INT AS last_char, NULL::INT AS n_chars, strong, NULL::DOUBLE AS score, '' AS same_text_in,
           CASE WHEN failed THEN 'failed' ELSE 'done' END AS text FROM o"""


@query("rc01_recall_path", _FILE)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, "path => 'file7.js'")


@query("rc01_recall_first_write", f"{_FILE} WHERE strong")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, "path => 'home/src/file7.js', mode => 'first'")


@query("rc01_recall_query", _searched([["tion", "onou"]], "TRUE", False))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, "query => 'the Tion, onou'")


@query("rc01_recall_queries_by_time", _searched([["tion", "ea"], ["onou", "der", "ent"], ["que"]], "role IN ('user', 'tool') AND seg = 1 AND message <= 7", True))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, "query => 'tion ea', queries => array('onou der ent', ' ', 'tion ea', 'que'), ord => 'time', roles => array('user', 'Output'), in_seg => 1, last => 7")
