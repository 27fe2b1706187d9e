"""The choice of lines for a question, and room shared among pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as X
from convlake.operators import leaves, outline
from convlake.plans.registry import query
from convlake.sources.archive import archive, read

QUERY, QUESTION, PLAIN = "thhe eron", "is erth or onre beside ouelle que", "que und"


def _choice(name: str, question: str, strict: bool) -> str:
    """CTEs that end in <name>(doc_id, units, reason), over u(doc_id, pos, w), s(doc_id, n, avgdl)."""
    words, identifiers = leaves.question_terms(question)
    assert words and not identifiers
    values = ", ".join(f"('{w}')" for w in words)
    weak = "len(b.got) < 2 AND NOT coalesce(b.rarest <= 3, FALSE)" if strict else "FALSE"
    return f"""{name}_h AS (SELECT doc_id, pos, term, len(list_filter(w, lambda x: x = term)) AS f, len(w) AS dl FROM u, (VALUES {values}) v(term)),
      {name}_d AS (SELECT doc_id, term, count(*) FILTER (f > 0) AS df FROM {name}_h GROUP BY ALL),
      {name}_r AS (SELECT doc_id, pos, n, round(coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * coalesce(dl / nullif(avgdl, 0), 0)))) FILTER (f > 0), 0), 9) AS score,
          coalesce(list(term) FILTER (f > 0), []) AS got, count(*) FILTER (f > 0 AND 2 * df <= n) AS cov, min(df) FILTER (f > 0 AND df <= greatest({leaves.MAX_BLOCKS}, n // 4)) AS rarest
        FROM {name}_h JOIN {name}_d USING (doc_id, term) JOIN s USING (doc_id) GROUP BY ALL),
      {name}_b AS (SELECT * FROM {name}_r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cov DESC, score DESC, pos) = 1),
      {name}_e AS (SELECT r.doc_id, r.pos, r.cov, r.score, r.score > 0 AND list_has_all(r.got, b.got) AS equal,
          r.cov >= b.cov AND r.score >= {leaves.NEAR} * b.score AND NOT list_has_all(b.got, r.got) AS near FROM {name}_r r JOIN {name}_b b USING (doc_id)),
      {name}_c AS (SELECT doc_id, count(*) FILTER (equal) AS n_equal, list(pos ORDER BY NOT equal, cov DESC, score DESC, pos)[:{leaves.MAX_BLOCKS}] AS units FROM {name}_e WHERE equal OR near GROUP BY doc_id),
      {name} AS (SELECT doc_id, CASE WHEN reason = '' THEN units ELSE [] END AS units, reason FROM (SELECT b.doc_id, c.units,
          CASE WHEN b.score <= 0 OR len(b.got) = 0 THEN 'no word found' WHEN b.rarest IS NULL THEN 'no telling word' WHEN {weak} THEN 'weak match'
               WHEN c.n_equal > {leaves.MAX_BLOCKS} THEN c.n_equal || ' equal blocks' ELSE '' END AS reason FROM {name}_b b LEFT JOIN {name}_c c USING (doc_id)))"""


_UNITS = """u AS (SELECT doc_id, pos, list_filter(regexp_extract_all(lower(line), '[0-9a-zà-öø-ÿ]+'), lambda x: length(x) > 1 OR regexp_full_match(x, '[0-9]')) AS w
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
    s AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS avgdl FROM u GROUP BY doc_id)"""
_SHOWN = "array_to_string(units, ',') AS units"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.coalesce("text", F.lit("")))).alias("p", "line"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), "line")


def _shown(units: str) -> Column:
    return F.array_join(F.transform(units, lambda x: x.cast("string")), ",").alias("units")


@query("lf16_chosen_lines", f"WITH {_UNITS}, {_choice('c', QUESTION, False)} SELECT doc_id, {_SHOWN}, reason FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return leaves.choose(_lines(spark, d), "doc_id", "pos", "line", QUESTION).select("doc_id", _shown("units"), "reason")


@query("lf16_chosen_lines_strict", f"WITH {_UNITS}, {_choice('c', PLAIN, True)} SELECT doc_id, {_SHOWN}, reason FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return leaves.choose(_lines(spark, d), "doc_id", "pos", "line", PLAIN, strict=True).select("doc_id", _shown("units"), "reason")


@query(
    "lf17_selected_lines",
    f"""WITH {_UNITS}, {_choice("q", QUERY, False)}, {_choice("t", QUESTION, True)}, {_choice("b", QUERY + " " + QUESTION, False)},
      j AS (SELECT doc_id, q.units AS q, t.units AS t, b.units AS b, len(q.units) = 1 AS one, len(t.units) BETWEEN 1 AND 2 AND NOT list_has_any(q.units, t.units) AS other FROM q JOIN t USING (doc_id) JOIN b USING (doc_id))
    SELECT doc_id, array_to_string((CASE WHEN one AND other THEN q || t WHEN one THEN q WHEN len(b) > 0 THEN b ELSE q END)[:{leaves.MAX_BLOCKS}], ',') AS units,
           CASE WHEN (one AND other) OR (NOT one AND len(b) > 0) THEN 'query,question' ELSE 'query' END AS guides FROM j WHERE len(q) > 0 OR len(b) > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = leaves.select_units(_lines(spark, d), "doc_id", "pos", "line", QUESTION, QUERY)
    return found.select("doc_id", _shown("units"), F.array_join("guides", ",").alias("guides"))


@query(
    "rc11_shared_room",
    """WITH RECURSIVE <archive>, o AS (SELECT conv, idx, tokens, row_number() OVER (PARTITION BY conv ORDER BY idx) AS k, count(*) OVER (PARTITION BY conv) AS n FROM archive),
      f AS (SELECT conv, 0::BIGINT AS k, greatest(0, 400 - 10 * count(*))::BIGINT AS room, NULL::INT AS idx, 0::BIGINT AS granted FROM archive GROUP BY conv
            UNION ALL SELECT o.conv, o.k, f.room - least(o.tokens, f.room // (o.n - o.k + 1)), o.idx, least(o.tokens, f.room // (o.n - o.k + 1)) FROM f JOIN o ON o.conv = f.conv AND o.k = f.k + 1)
    SELECT conv, idx, granted FROM f WHERE k > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return leaves.shared_room(archive(spark, d), ["conv"], ["idx"], 400, frame=10).select("conv", "idx", "granted")


@query(
    "lf06_column_tables",
    """WITH t AS (SELECT part_order.*, count(*) OVER (PARTITION BY l_orderkey) AS n, l_orderkey % 4 AS kind FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS line_no, l_partkey, l_suppkey, l_shipdate, l_comment_words
         FROM (SELECT *, l_returnflag || ' ' || l_linestatus AS l_comment_words FROM lineitem)) part_order)
       SELECT l_orderkey, line_no, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supplier, l_shipdate::DATE::VARCHAR AS shipped, CASE WHEN kind = 1 AND line_no = 1 THEN '' ELSE l_comment_words || CASE WHEN kind = 0 THEN ' more' ELSE '' END END AS note
       FROM t WHERE n >= 2 AND kind < 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as an aligned table: with notes of any length, without the first note, with headings in small letters, as prose."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = read(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("at"), "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string").alias("shipped"), "l_returnflag", "l_linestatus")
    kind = F.col("l_orderkey") % 4
    note = F.when((kind == 1) & (F.col("at") == 1), F.lit("")).otherwise(F.concat_ws(" ", "l_returnflag", "l_linestatus", F.when(kind == 0, F.lit("more"))))
    gap = F.when(kind == 3, F.lit(" ")).otherwise(F.lit("  "))
    line = F.rtrim(F.concat(F.rpad(F.col("l_partkey").cast("string"), 12, " "), gap, F.rpad(F.col("l_suppkey").cast("string"), 12, " "), gap, F.rpad("shipped", 10, " "), gap, note))
    line = F.when(kind == 3, F.regexp_replace(line, " +", " ")).otherwise(line)
    head = F.when(kind == 2, F.lit("part          supplier      shipped     note")).otherwise(F.lit("PART          SUPPLIER      SHIPPED     NOTE"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n")
    texts = rows.groupBy("l_orderkey").agg(F.concat(F.first(head), F.lit("\n"), lines).alias("body"))
    cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("part", "supplier", "shipped", "note"))]
    return outline.column_tables(texts, "l_orderkey", "body").select("l_orderkey", "line_no", *cells)


@query(
    "lf01_line_ancestors",
    """WITH RECURSIVE l AS (SELECT doc_id, pos, indent, max(pos) AS last_pos FROM (
           SELECT doc_id, (pos - 1)::INT AS pos, length(line) % 5 AS indent FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> '') GROUP BY ALL),
       p AS (SELECT a.doc_id, a.pos, a.indent, max(b.pos) AS parent FROM l a LEFT JOIN l b ON b.doc_id = a.doc_id AND b.pos < a.pos AND b.indent < a.indent GROUP BY ALL),
       r AS (SELECT doc_id, pos, indent, parent AS up, '' AS path FROM p UNION ALL SELECT r.doc_id, r.pos, r.indent, p.parent, r.up || '/' || r.path FROM r JOIN p ON p.doc_id = r.doc_id AND p.pos = r.up)
       SELECT doc_id, pos AS line_no, indent::INT AS indent, path FROM r WHERE up IS NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines, indented by the rest of their length over 5."""
    line = lambda x: F.concat(F.repeat(F.lit(" "), F.length(x) % 5), F.ltrim(x))
    texts = read(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("body"))
    found = outline.line_ancestors(texts, "doc_id", "body")
    path = F.concat(F.array_join(F.transform("ancestors", lambda a: a.cast("string")), "/"), F.when(F.size("ancestors") > 0, "/").otherwise(""))
    return found.select("doc_id", "line_no", "indent", path.alias("path"))
