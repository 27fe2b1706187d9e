"""Recall results that show nothing new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.operators import coverage
from convlake.plans.registry import query
from convlake.sources.archive import read

_RESULTS = """e AS (SELECT event_id AS idx, json_extract_string(props, '$.k')::INT % 10 AS conv, 'src/file' || json_extract_string(props, '$.k') || '.js' AS rid, event_type, floor(value * 100)::INT AS a, floor(value)::INT AS line,
         event_type || ' ' || json_extract_string(props, '$.k') || ' ' || floor(value)::INT AS text FROM events),
  s AS (SELECT conv, idx, rid, text, CASE WHEN event_type = 'signup' OR a < 0 THEN 'opaque' WHEN event_type = 'error' AND line % 7 = 0 THEN 'cut' WHEN event_type = 'error' THEN 'leaf' WHEN event_type = 'click' THEN 'lines' ELSE 'span' END AS kind, a, a + 50 + (idx % 977)::INT AS b, line FROM e)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Events as results: views and purchases show a span of a file, clicks and errors lines of it; some are cut, signups are groups."""
    k, line, a = F.get_json_object("props", "$.k"), F.floor("value").cast("int"), F.floor(F.col("value") * 100).cast("int")
    kind = F.col("event_type")
    rows = F.sequence(line, line + 2)
    entry = F.struct(
        F.concat(F.lit("src/file"), k, F.lit(".js")).alias("rid"), F.when(kind.isin("view", "purchase", "signup"), a).alias("offset"), (50 + F.col("event_id") % 977).cast("int").alias("chars"),
        ((kind == "error") & (line % 7 == 0)).alias("cut"), ((kind == "signup") | (a < 0)).alias("grouped"), F.when(kind == "click", rows).alias("line_set"), F.when(kind == "error", rows).alias("leaf_lines"),
    )
    return read(spark, d, "events").select(
        (k.cast("int") % 10).alias("conv"), F.col("event_id").alias("idx"), F.concat_ws(" ", kind, k, line.cast("string")).alias("text"), coverage.sources(F.array(entry)).alias("sources")
    )


@query(
    "tx14_result_sources",
    f"WITH {_RESULTS} SELECT conv, idx, kind, rid, CASE WHEN kind = 'span' THEN a END AS a, CASE WHEN kind = 'span' THEN b END AS b, CASE WHEN kind IN ('lines', 'leaf') THEN concat_ws(',', line, line + 1, line + 2) END AS lines FROM s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    shown = _results(spark, d).select("conv", "idx", F.explode("sources").alias("s")).select("conv", "idx", "s.*")
    return shown.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query(
    "st05_verified_copies",
    f"""WITH RECURSIVE {_RESULTS}, p AS (SELECT conv, idx, rid, a, b FROM s WHERE kind = 'span'),
      r AS (SELECT conv, idx, rid, a AS pos, b, 0 AS n FROM p
            UNION ALL SELECT r.conv, r.idx, r.rid, max(o.b), r.b, r.n + 1 FROM r JOIN p o ON o.conv = r.conv AND o.rid = r.rid AND o.idx < r.idx AND o.a <= r.pos AND o.b > r.pos WHERE r.pos < r.b GROUP BY r.conv, r.idx, r.rid, r.pos, r.b, r.n),
      l AS (SELECT conv, idx, rid, kind, unnest([line, line + 1, line + 2]) AS x FROM s WHERE kind IN ('lines', 'leaf')),
      f AS (SELECT *, min(idx) OVER (PARTITION BY conv, rid, kind, x) AS seen FROM l),
      t AS (SELECT conv, idx FROM (SELECT conv, idx, min(idx) OVER (PARTITION BY conv, text) AS seen FROM s) WHERE seen < idx),
      c AS (SELECT conv, idx, n FROM r WHERE pos >= b UNION ALL SELECT conv, idx, count(DISTINCT seen) FROM f GROUP BY conv, idx HAVING bool_and(seen < idx))
    SELECT conv, idx, 'text' AS "by", 1::INT AS n_witnesses FROM t UNION ALL SELECT conv, idx, 'cover', n::INT FROM c ANTI JOIN t USING (conv, idx)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return coverage.verified_copies(_results(spark, d), ["conv"]).select("conv", "idx", "by", F.size("witnesses").alias("n_witnesses"))
