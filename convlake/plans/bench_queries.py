"""The retrieval bench over questions that the conversations give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.functions.text import terms
from convlake.operators import retrieval_bench as bench
from convlake.plans.registry import TERMS, query
from convlake.sources import scratch
from convlake.sources.archive import archive

SHOWN, CHARS = 8, 300

_ASKED = f"""<archive>, t AS (SELECT *, {TERMS.format("content")} AS toks FROM archive),
  q AS (SELECT conv AS qid, rid, 'k' || conv % 3 AS kind, conv % 5 = 0 AS neg, list_transform(list_sort(list_transform(list_distinct(list_filter(toks, lambda x: length(x) >= 4)), lambda x: {{'n': -length(x), 'x': x}}))[:3], lambda s: s.x) AS w FROM t WHERE idx = 1),
  c AS (SELECT qid, 1 AS call, CASE WHEN neg THEN list_transform(w[2:], lambda x: 'zq' || x) ELSE w[2:] END AS words FROM q UNION ALL SELECT qid, 2, CASE WHEN neg THEN list_concat(w[:1], ['zqzq']) ELSE w END FROM q),
  e AS (SELECT qid, g, rid, w[g] AS pattern FROM q, (VALUES (1), (2)) v(g) WHERE NOT neg AND len(w) >= g),
  a AS (SELECT DISTINCT qid, call, len(list_distinct(words)) AS n_words, unnest(words) AS term FROM c),
  f AS (SELECT conv, idx, rid, len(toks) AS dl, term, count(*) AS f FROM (SELECT *, unnest(toks) AS term FROM t) GROUP BY ALL),
  s AS (SELECT count(*) AS n_all, avg(len(toks)) AS avgdl FROM t), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
  b AS (SELECT qid, call, conv, idx, rid, count(*) = n_words AS strong, round(sum(greatest(ln((n_all - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM a JOIN f USING (term) JOIN d USING (term), s GROUP BY qid, call, conv, idx, rid, n_words),
  r AS (SELECT b.*, left(content, {CHARS}) AS txt, row_number() OVER (PARTITION BY qid, call ORDER BY score DESC, b.conv, b.idx) AS place FROM b JOIN archive x ON x.conv = b.conv AND x.idx = b.idx QUALIFY place <= {SHOWN}),
  o AS (SELECT qid, call, list(rid ORDER BY place) AS rids, string_agg(txt, chr(10) ORDER BY place) AS out, sum(floor(length(txt) / 3.5 + 0.5))::BIGINT AS tok, bool_or(strong) AS strong FROM r GROUP BY ALL),
  h AS (SELECT e.qid, g, min(call) AS call, bool_or(call = 1 AND list_contains(o.rids[:5], e.rid)) AS early FROM e JOIN o USING (qid) WHERE list_contains(o.rids, e.rid) AND contains(o.out, pattern) GROUP BY ALL),
  m AS (SELECT q.qid, kind, neg, (SELECT count(*) FROM e WHERE e.qid = q.qid) AS n_groups, (SELECT count(*) FROM h WHERE h.qid = q.qid) AS covered, (SELECT count(*) FROM h WHERE h.qid = q.qid AND early) AS n_early,
           (SELECT max(call) FROM h WHERE h.qid = q.qid) AS needed, (SELECT min(place) FROM r JOIN e ON e.qid = r.qid AND e.rid = r.rid WHERE r.qid = q.qid AND r.call = 1) AS rank FROM q),
  z AS (SELECT qid, kind, neg, n_groups, covered, n_groups > 0 AND n_early = n_groups AS e5, n_groups > 0 AND covered = n_groups AS eb, rank, coalesce(1.0 / rank, 0)::DOUBLE AS rr, CASE WHEN n_groups > 0 AND covered = n_groups THEN needed ELSE 2 END AS n_calls FROM m),
  y AS (SELECT z.*, (SELECT coalesce(sum(tok), 0)::BIGINT FROM o WHERE o.qid = z.qid AND o.call <= z.n_calls) AS tokens, (SELECT coalesce(bool_or(strong), false) FROM o WHERE o.qid = z.qid AND o.call <= z.n_calls) AS strong FROM z)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation asks for its second message by its longest words, without the longest first; a fifth asks for words that are nowhere."""
    pieces = archive(spark, d)
    long = F.array_distinct(F.filter(terms(F.col("content")), lambda x: F.length(x) >= 4))
    longest = F.transform(F.slice(F.array_sort(F.transform(long, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1, 3), lambda s: s["x"])
    asked = pieces.where("idx = 1").select(F.col("conv").alias("qid"), "rid", F.concat(F.lit("k"), F.col("conv") % 3).alias("kind"), (F.col("conv") % 5 == 0).alias("neg"), longest.alias("w"))
    rest, none = F.slice("w", 2, 2), F.concat(F.slice("w", 1, 1), F.array(F.lit("zqzq")))
    first = F.when(F.col("neg"), F.transform(rest, lambda x: F.concat(F.lit("zq"), x))).otherwise(rest)
    second = F.when(F.col("neg"), none).otherwise(F.col("w"))
    calls = asked.select("qid", F.posexplode(F.array(first, second)).alias("call", "words")).withColumn("call", F.col("call") + 1)
    evidence = asked.where("NOT neg").select("qid", F.array("rid").alias("rids"), F.posexplode(F.slice("w", 1, 2)).alias("grp", "pattern"))
    out = scratch.folder(spark, "answers")
    # read four times below
    bench.answers(pieces, calls, SHOWN, CHARS).write.parquet(out)
    return bench.scores(asked.select("qid", "kind", "neg"), evidence, calls, spark.read.parquet(out))


@query("bm01_question_scores", f"WITH {_ASKED} SELECT qid, kind, neg, n_groups, covered, e5, eb, rank, rr, n_calls, tokens, strong FROM y")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(
    "bm01_retrieval_bench",
    f"""WITH {_ASKED} SELECT kind, count(*) FILTER (NOT neg) AS n, round(avg(e5::INT) FILTER (NOT neg), 6) AS e5, round(avg(eb::INT) FILTER (NOT neg), 6) AS eb, round(avg(rr) FILTER (NOT neg), 6) AS mrr,
         round(avg(tokens) FILTER (NOT neg), 6) AS tokens, round(avg(n_calls) FILTER (NOT neg), 6) AS calls, count(*) FILTER (neg) AS neg_n, count(*) FILTER (neg AND NOT strong) AS neg_ok FROM y GROUP BY ROLLUP (kind)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return bench.summary(_scores(spark, d))
