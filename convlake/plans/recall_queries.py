"""Orders of results, siblings of a message, automatic recall and the switch of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as X
from convlake.operators import budget, records
from convlake.plans.registry import TERMS, query
from convlake.plans.search_queries import _bm25_sql, _scored, _STEM
from convlake.sources.archive import archive, file_ops, read

#: Pieces and tokens that automatic recall may bring into a prompt.
INJECTED, INJECTED_TOKENS = 4, 120
WINDOW, RESPONSE, RESERVE, GUARD = 400, 80, 20, 8
QUESTION = ["the", "der", "que"]
_CONTENT = TERMS.format("content")
_PARTS = """parts AS (SELECT conv_id AS conv, turn AS idx, 'message' AS part FROM conversations
  UNION ALL SELECT conv_id, turn, unnest(['first_line', 'args']) FROM conversations WHERE role = 'assistant')"""


@query("tk02_time_order", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid", _CONTENT, "SELECT conv, idx, rid, n_terms >= 2 AS strong, row_number() OVER (PARTITION BY conv ORDER BY n_terms >= 2 DESC, idx) AS place FROM scored"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a conversation, strong ones first, then by time."""
    hits = _scored(archive(spark, d)).withColumn("strong", F.col("n_terms") >= 2)
    return hits.select("conv", "idx", "rid", "strong", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("strong").desc(), "idx")).alias("place"))


@query(
    "tk04_coverage_first",
    "WITH l AS (SELECT doc_id, u.line, u.pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u), t AS (SELECT doc_id, pos, "
    + TERMS.format("line")
    + " AS toks FROM l), s AS (SELECT doc_id, count(*) AS n, avg(len(toks)) AS avgdl FROM t GROUP BY doc_id), h AS (SELECT t.doc_id, pos, term, len(list_filter(toks, lambda x: x = term)) AS f, len(toks) AS dl FROM t, (VALUES ('the'), ('der'), ('que')) v(term)), d AS (SELECT doc_id, term, count(*) AS df FROM h WHERE f > 0 GROUP BY ALL), r AS (SELECT doc_id, pos, count(*) AS covered, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN d USING (doc_id, term) JOIN s USING (doc_id) WHERE f > 0 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY covered DESC, score DESC, pos) AS place FROM r) SELECT doc_id, pos, covered, place FROM p WHERE place <= 10",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The ten lines of each text that cover most words of the question; among equals by score, then by place."""
    units = read(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("pos"), "line")
    ranked = records.rank_units(units, "doc_id", "pos", "line", QUESTION, covered=True)
    w = Window.partitionBy("doc_id").orderBy(F.col("covered").desc(), F.col("score").desc(), "pos")
    return ranked.withColumn("place", F.row_number().over(w)).where("place <= 10").select("doc_id", "pos", "covered", "place")


@query(
    "tk06_tool_search_order",
    "WITH <ops>, t AS (SELECT op || '_' || path AS name, count(*) AS uses FROM ops GROUP BY 1), s AS (SELECT name, uses, name = 'read_src/file7.js' AS exact, 4 * (starts_with(name, 'read'))::INT + 2 * (contains(name, 'file7'))::INT AS score FROM t) SELECT name, exact, score FROM s WHERE exact OR score > 0 ORDER BY exact DESC, score DESC, name LIMIT 5",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The five tools that fit a request best: the exact name, then by score, then by name."""
    tools = file_ops(spark, d).select(F.concat_ws("_", "op", "path").alias("name")).distinct()
    score = 4 * F.startswith("name", F.lit("read")).cast("int") + 2 * F.contains("name", F.lit("file7")).cast("int")
    found = tools.select("name", (F.col("name") == "read_src/file7.js").alias("exact"), score.alias("score")).where("exact OR score > 0")
    return found.orderBy(F.col("exact").desc(), F.col("score").desc(), "name").limit(5)


@query(
    "ft07_normal_text",
    r"WITH t AS (SELECT doc_id, p.w, p.pos FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS w, generate_subscripts(d.a, 1) AS pos) p), g AS (SELECT doc_id, pos, lower(w) AS w, list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) AS parts FROM t), n AS (SELECT doc_id, pos, "
    + _STEM
    + " AS whole, CASE WHEN len(parts) > 1 THEN list_transform(parts, lambda w: "
    + _STEM
    + ") ELSE [] END AS parts FROM g), o AS (SELECT doc_id, pos, whole, list_filter(parts, lambda x: x <> whole) AS parts FROM n), x AS (SELECT doc_id, pos, array_to_string([whole] || list_filter(parts, lambda x, i: list_position(parts, x) = i), ' ') AS body FROM o) SELECT d.doc_id, coalesce(string_agg(x.body, ' ' ORDER BY x.pos), '') AS normal FROM documents d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the index sees them: stems of words, each followed by those of its parts."""
    return read(spark, d, "documents").select("doc_id", F.array_join(F.flatten(X.token_groups(F.col("text"))), " ").alias("normal"))


@query(
    "ft22_injection",
    "WITH RECURSIVE <archive>, "
    + _bm25_sql(
        "archive",
        "conv, idx, rid, tokens",
        _CONTENT,
        f"c AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY score DESC, idx) AS place FROM scored WHERE n_terms >= 2), w AS (SELECT conv, rid, place, tokens <= {INJECTED_TOKENS} AS taken, CASE WHEN tokens <= {INJECTED_TOKENS} THEN tokens ELSE 0 END AS used, (tokens <= {INJECTED_TOKENS})::INT AS n FROM c WHERE place = 1 UNION ALL SELECT c.conv, c.rid, c.place, w.used + c.tokens <= {INJECTED_TOKENS} AND w.n < {INJECTED}, w.used + CASE WHEN w.used + c.tokens <= {INJECTED_TOKENS} AND w.n < {INJECTED} THEN c.tokens ELSE 0 END, w.n + (w.used + c.tokens <= {INJECTED_TOKENS} AND w.n < {INJECTED})::INT FROM w JOIN c ON c.conv = w.conv AND c.place = w.place + 1) SELECT conv, rid FROM w WHERE taken",
    ).replace("\n    c AS", ",\n    c AS"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """What automatic recall brings into each conversation: the best candidates that fit its tokens, four at most."""
    hits = _scored(archive(spark, d)).where("n_terms >= 2")
    return budget.take_what_fits(hits, ["conv"], [F.col("score").desc(), F.col("idx")], INJECTED_TOKENS, most=INJECTED)


@query("rc09_siblings", "WITH " + _PARTS + " SELECT a.conv, a.idx, a.part, b.part AS sibling FROM parts a JOIN parts b ON a.conv = b.conv AND a.idx = b.idx AND a.part <> b.part")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The other parts of the message that a part belongs to; parts of one message are made in its own row, so nothing is joined."""
    parts = F.when(F.col("role") == "assistant", F.array(*map(F.lit, ("message", "first_line", "args")))).otherwise(F.array(F.lit("message")))
    rows = archive(spark, d).select("conv", "idx", parts.alias("parts")).select("*", F.explode("parts").alias("part"))
    return rows.select("conv", "idx", "part", F.explode(F.array_except("parts", F.array("part"))).alias("sibling"))


@query(
    "seg01_switch",
    f"WITH <archive>, e AS (SELECT conv, idx, sum(tokens + 6) OVER (PARTITION BY conv ORDER BY idx) + 3 AS est FROM archive) SELECT conv, min(idx) AS switch_idx, min(est)::BIGINT AS estimate FROM e WHERE est + {RESPONSE} + {RESERVE} + {GUARD} > {WINDOW} GROUP BY conv",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first message of each conversation with which prompt, response and reserve no longer fit into the window."""
    w = Window.partitionBy("conv").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = archive(spark, d).select("conv", "idx", (F.sum(F.col("tokens") + 6).over(w) + 3).alias("estimate"))
    return rows.where(F.col("estimate") + RESPONSE + RESERVE + GUARD > WINDOW).groupBy("conv").agg(F.min("idx").alias("switch_idx"), F.min("estimate").alias("estimate"))
