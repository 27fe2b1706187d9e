"""Full-text search, budgets, masks, text functions and semi-structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as X
from convlake.operators import budget, lifecycle, records, search, structure
from convlake.operators.search_index import SearchIndex
from convlake.plans.registry import FOLD, TERMS, query
from convlake.sources.archive import archive, document_archive, file_ops, read
from convlake.sources.scratch import folder

#: Characters of a piece of a user's events of a day.
UNIT_CHARS = 500_000
WANTED = ["the", "tion", "der", "onou"]
_VALUES = "(VALUES " + ", ".join(f"('{w}')" for w in WANTED) + ") v(term)"


def _bm25_sql(table: str, key: str, toks: str, tail: str, wanted: str = _VALUES) -> str:
    return f"""docs AS (SELECT *, {toks} AS toks FROM {table}), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
      hit AS (SELECT d.*, v.term, len(list_filter(d.toks, lambda x: x = v.term)) AS f, len(d.toks) AS dl FROM docs d, {wanted}),
      df AS (SELECT term, count(*) AS nq FROM hit WHERE f > 0 GROUP BY term),
      scored AS (SELECT {key}, round(sum(greatest(ln((n - nq + 0.5) / (nq + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS n_terms FROM hit JOIN df USING (term), st WHERE f > 0 GROUP BY ALL)
    {tail}"""


def _scored(rows: DataFrame, wanted: list[str] = WANTED, **more) -> DataFrame:
    return search.bm25(rows, wanted, **more).withColumn("score", F.round("score", 6))


_CONTENT = TERMS.format("content")


@query("ft02_bm25_or_search", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid", _CONTENT, "SELECT * FROM scored ORDER BY score DESC, conv, idx LIMIT 20"))
def bm25_or_search(spark: SparkSession, d: str) -> DataFrame:
    return search.top(_scored(archive(spark, d)).select("conv", "idx", "rid", "score", "n_terms"), 20, "conv", "idx")


@query("ft02_bm25_all_hits", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid", _CONTENT, "SELECT * FROM scored"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _scored(archive(spark, d)).select("conv", "idx", "rid", "score", "n_terms")


@query("ft03_bm25_documents", "WITH " + _bm25_sql("documents", "doc_id", TERMS.format("text"), "SELECT * FROM scored WHERE n_terms >= 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _scored(read(spark, d, "documents"), content="text").where("n_terms >= 2").select("doc_id", "score", "n_terms")


@query("ft01_terms", "WITH <archive> SELECT conv, idx, array_to_string(" + _CONTENT + ", ' ') AS terms FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).select("conv", "idx", F.array_join(X.terms(F.col("content")), " ").alias("terms"))


_STEM = r"""CASE WHEN regexp_full_match(w, '\p{L}+') AND length(w) > 3 THEN regexp_replace(regexp_replace(regexp_replace(w, '^(.{4,})(?:ing|ed)$', '\1'), '^(.{3,}[^s])s$', '\1'), '^(.{3,})[aeiouàèéìòù]$', '\1') ELSE w END"""


@query("ft05_stems", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) SELECT w AS word, " + _STEM + " AS stem FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "documents").select(F.explode(F.array_distinct(X.words(F.lower("text")))).alias("word")).distinct()
    return found.select("word", X.stem(F.col("word")).alias("stem"))


@query(
    "ft06_identifier_parts",
    "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[A-Za-z0-9_]+')) AS w FROM pages), p AS (SELECT w, list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) AS parts FROM t) SELECT w AS token, array_to_string(parts, ' ') AS parts FROM p WHERE len(parts) > 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "pages").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("token")).distinct()
    return found.select("token", F.array_join(X.ident_parts(F.col("token")), " ").alias("parts")).where("parts <> ''")


@query("ft04_strict_search", "WITH <archive> SELECT conv, idx FROM (SELECT *, list_transform(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), lambda w: " + _STEM + ") AS s FROM archive) WHERE list_contains(s, 'the') AND (list_contains(s, 'thation') OR list_has_all(s, ['th', 'and']) OR list_has_all(s, ['of', 'and']))")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    one, two = (search.holds_all(F.col("content"), [["the"], ["thation", *pair]]) for pair in (("th", "and"), ("of", "and")))
    return rows.where(one | two).select("conv", "idx")


@query("ft08_passages", "SELECT doc_id, CAST(o * 550 AS INT) AS off, length(substr(text, o * 550 + 1, 700)) AS len, sha256(substr(text, o * 550 + 1, 700)) AS hash FROM documents, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(text) - 700) / 550.0)) AS BIGINT) + 1)) AS o)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.passages(read(spark, d, "documents"), "text").select("doc_id", "off", "len", F.sha2("passage", 256).alias("hash"))


@query(
    "ft08_snapped_windows",
    """WITH RECURSIVE l AS (SELECT doc_id, u.pos, length(u.line) + 1 AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u),
       c AS (SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS behind FROM l),
       t AS (SELECT doc_id, max(behind) - 1 AS n, list(behind ORDER BY pos)[:-2] AS ends FROM c GROUP BY doc_id),
       w AS (SELECT doc_id, n, ends, 0::BIGINT AS off, CASE WHEN 700 >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e > 350 AND e <= 700)), 700) END AS stop FROM t
             UNION ALL
             SELECT doc_id, n, ends, off, CASE WHEN off + 700 >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e > off + 350 AND e <= off + 700)), off + 700) END
             FROM (SELECT doc_id, n, ends, CASE WHEN first > off + 1 THEN first ELSE plain END AS off
                   FROM (SELECT *, list_min(list_filter(ends, lambda e: e > plain - 80 AND e <= plain)) AS first FROM (SELECT *, least(off + 550, stop) AS plain FROM w WHERE stop < n))))
       SELECT doc_id, off::INT AS off, (stop - off)::INT AS len FROM w""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.snapped_windows(read(spark, d, "documents"), "doc_id", "text")


_PASSAGES = "p AS (SELECT doc_id, CAST(o * 550 AS INT) AS off, substr(text, o * 550 + 1, 700) AS passage FROM documents, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(text) - 700) / 550.0)) AS BIGINT) + 1)) AS o))"


@query("ft10_passage_search", "WITH " + _PASSAGES + ", " + _bm25_sql("p", "doc_id, off", TERMS.format("passage"), "SELECT doc_id, off, score, n_terms FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, off) = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = search.passages(read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "off", "passage")
    return search.best_per(_scored(parts, content="passage"), "doc_id").select("doc_id", "off", "score", "n_terms")


@query("ft09_indexed_search", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid", _CONTENT, "SELECT * FROM scored"))
def _(spark: SparkSession, d: str) -> DataFrame:
    index, rows = SearchIndex(spark, folder(spark, "search-index"), window=None), archive(spark, d)
    for part in ("conv % 3 = 0", "conv % 3 <= 1", "true"):
        index.ensure(rows.where(part))
    return index.search(WANTED).withColumn("score", F.round("score", 6)).select("conv", "idx", "rid", "score", "n_terms")


@query("ft09_indexed_passages", "WITH " + _PASSAGES + ", " + _bm25_sql("p", "doc_id, off", TERMS.format("passage"), "SELECT doc_id, off, score, n_terms FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, off) = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    index = SearchIndex(spark, folder(spark, "search-index"))
    rows = read(spark, d, "documents").select(F.col("source").alias("conv"), F.lit(0).alias("idx"), F.col("doc_id").cast("string").alias("rid"), F.lit("tool").alias("role"), F.col("text").alias("content"))
    for part in ("crc32(rid) % 2 = 0", "true"):
        index.ensure(rows.where(part))
    found = index.search(WANTED).withColumn("score", F.round("score", 6)).withColumn("doc_id", F.col("rid").cast("long"))
    return search.best_per(found, "doc_id").select("doc_id", "off", "score", "n_terms")


@query("ft11_phrase_search", "WITH <archive> SELECT conv, idx FROM archive WHERE contains(' ' || array_to_string(" + _CONTENT + ", ' ') || ' ', ' of the ')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).where(search.holds_phrase(F.col("content"), "Of  the")).select("conv", "idx")


def _variant(q: str, words: list[str]) -> str:
    values = "(VALUES " + ", ".join(f"('{w}')" for w in words) + ") v(term)"
    return f"(WITH {_bm25_sql('archive', 'conv, idx, rid', _CONTENT, f'''SELECT '{q}' AS query, conv, idx, rid, score, n_terms = {len(words)} AS strong FROM scored''', values)})"


@query("ft12_rank_fusion", "WITH <archive>, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY strong DESC, score DESC, conv, idx) - 1 AS rank FROM (SELECT * FROM " + _variant("a", ["the", "tion"]) + " UNION ALL SELECT * FROM " + _variant("b", ["onou", "der", "and"]) + ")) SELECT rid, round(sum(1.0::DOUBLE / (30 + rank)), 9) AS fused, bool_or(strong) AS strong, count(*) AS n_queries FROM r GROUP BY rid")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    hits = None
    for name, words in (("a", ["the", "tion"]), ("b", ["onou", "der", "and"])):
        part = _scored(rows, words).select(F.lit(name).alias("query"), "conv", "idx", "rid", "score", (F.col("n_terms") == len(words)).alias("strong"))
        hits = part if hits is None else hits.unionByName(part)
    return search.fuse(hits).withColumn("fused", F.round("fused", 9))


@query("ft13_excerpt", "WITH <archive>, p AS (SELECT conv, idx, content, list_min(list_filter([instr(" + FOLD.format("content") + ", 'tion'), instr(" + FOLD.format("content") + ", 'der')], lambda x: x > 0)) AS pos FROM archive) SELECT conv, idx, substr(content, greatest(1, coalesce(pos, 1) - 160), 1100) AS excerpt FROM p")
def _(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).select("conv", "idx", search.excerpt(F.col("content"), ["tion", "der"]).alias("excerpt"))


@query(
    "ft15_matching_lines",
    "WITH <archive>, l AS (SELECT rid, u.line, u.pos FROM (SELECT rid, string_split(content, chr(10)) AS a FROM archive) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u), h AS (SELECT *, contains(" + FOLD.format("line") + ", 'tion') AS hit FROM l), n AS (SELECT *, bool_or(hit) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) SELECT rid, pos AS line_no, line, hit FROM n WHERE near",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(archive(spark, d), ["tion"])


@query("ft18_hits_per_term", "WITH <archive>, t AS (SELECT rid, unnest(list_distinct(" + _CONTENT + ")) AS term FROM archive) SELECT term, count(*) AS n FROM t WHERE term IN ('the', 'tion', 'der', 'onou', 'nothere') GROUP BY term")
def _(spark: SparkSession, d: str) -> DataFrame:
    toks = F.array_intersect(X.terms(F.col("content")), F.array(*map(F.lit, [*WANTED, "nothere"])))
    return archive(spark, d).select(F.explode(toks).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@query("ft19_query_terms", "WITH <archive> SELECT conv, idx, array_to_string(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + _STOPS + ", w))[1:24], ' ') AS terms FROM archive WHERE role = 'user'")
def _(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(X.words(F.lower("content")), lambda w: (F.length(w) >= 3) & ~w.isin(*X.STOP_WORDS))
    return archive(spark, d).where("role = 'user'").select("conv", "idx", F.array_join(F.slice(kept, 1, 24), " ").alias("terms"))


@query("ft21_auto_candidates", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid, content", _CONTENT, "SELECT sha1(trim(content)) AS hash, max(score) AS score, min(rid) AS rid FROM scored WHERE n_terms >= 2 AND idx >= 1 GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = _scored(archive(spark, d), where=F.col("idx") >= 1).where("n_terms >= 2")
    return hits.groupBy(F.sha1(F.btrim("content")).alias("hash")).agg(F.max("score").alias("score"), F.min("rid").alias("rid"))


@query("ft24_tool_search", "WITH t AS (SELECT page_id, regexp_extract_all(lower(url), '[a-z]+') AS a, lower(url) AS u FROM pages) SELECT page_id, 4 * len(list_intersect(list_distinct(a), ['blog', 'fr'])) + 1.5 * ((contains(u, 'blog'))::INT + (contains(u, 'fr'))::INT) AS score FROM t WHERE contains(u, 'blog') OR contains(u, 'fr')")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = F.lower("url")
    have = F.regexp_extract_all(u, F.lit("[a-z]+"), F.lit(0))
    part = F.contains(u, F.lit("blog")).cast("int") + F.contains(u, F.lit("fr")).cast("int")
    return read(spark, d, "pages").where(part > 0).select("page_id", (4 * F.size(F.array_intersect(have, F.array(F.lit("blog"), F.lit("fr")))) + 1.5 * part).alias("score"))


@query("ft25_identifiers", "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(url, '[A-Za-z0-9_][A-Za-z0-9_./-]*[A-Za-z0-9_]'), lambda t: regexp_matches(t, '[0-9]') OR regexp_matches(t, '[A-Za-z0-9][_./-][A-Za-z0-9]') OR regexp_matches(t, '[a-z][A-Z]')))), ' ') AS identifiers FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.array_join(F.array_sort(X.identifiers(F.col("url"))), " ").alias("identifiers"))


#: Different runs of eight words of a text.
_WORDS_SQL = r"regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS words"
_SHINGLES_SQL = "list_transform(range(1, greatest(1, len(words) - 6)), lambda i: array_to_string(words[i:i + 7], ' ')) AS shingles"


def _shingles(text: str) -> Column:
    """The same as 64-bit hashes."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, F.lit(8))))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= 8, F.array_distinct(runs(w))).otherwise(F.array().cast("array<bigint>")))[0]


@query(
    "ag15_retrieval_metrics",
    f"""WITH q AS (SELECT item_id, body, {_SHINGLES_SQL} FROM (SELECT item_id, text AS body, {_WORDS_SQL} FROM benchmark)), d AS (SELECT doc_id, body, {_SHINGLES_SQL} FROM (SELECT doc_id, text AS body, {_WORDS_SQL} FROM documents)),
      qs AS (SELECT item_id, unnest(list_distinct(shingles)) AS s FROM q), ds AS (SELECT doc_id, unnest(list_distinct(shingles)) AS s FROM d),
      hit AS (SELECT item_id, doc_id, s FROM qs JOIN ds USING (s)), n AS (SELECT item_id, doc_id, count(*) AS n FROM hit GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS place FROM n),
      top AS (SELECT item_id, count(DISTINCT s) AS shown FROM hit JOIN r USING (item_id, doc_id) WHERE place <= 5 GROUP BY item_id),
      first AS (SELECT r.item_id, min(place) AS place FROM r JOIN q USING (item_id) JOIN d USING (doc_id) WHERE contains(d.body, q.body) GROUP BY r.item_id)
      SELECT count(*) AS questions, count(first.place) AS found, round(avg(coalesce(shown / nullif(len(list_distinct(shingles)), 0), 0)), 6) AS e5, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr
      FROM q LEFT JOIN top USING (item_id) LEFT JOIN first USING (item_id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval by common shingles: how much of a whole passage the best five documents show, and the place of the first that holds all of it."""
    questions = read(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"), _shingles("text").alias("shingles"))
    asked = questions.select("item_id", F.explode("shingles").alias("s"))
    have = read(spark, d, "documents").select("doc_id", F.explode(_shingles("text")).alias("s"))
    hits = have.join(asked, "s").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"), F.collect_set("s").alias("shown"))
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("n").desc(), "doc_id")))
    shown = ranked.where("place <= 5").select("item_id", F.explode("shown").alias("s")).groupBy("item_id").agg(F.count_distinct("s").alias("shown"))
    texts = ranked.select("item_id", "doc_id", "place").join(questions.select("item_id", "passage"), "item_id").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    first = texts.where(F.contains("text", "passage")).groupBy("item_id").agg(F.min("place").alias("place"))
    share = F.coalesce(F.try_divide("shown", F.size("shingles")), F.lit(0.0))
    rows = questions.join(shown, "item_id", "left").join(first, "item_id", "left")
    return rows.agg(F.count("*").alias("questions"), F.count("place").alias("found"), F.round(F.avg(share), 6).alias("e5"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))


# Budgets
@query("gr01_take_until_overflow", "WITH <archive>, u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv ORDER BY idx) AS used FROM archive) SELECT conv, idx, used::BIGINT AS used FROM u WHERE used <= 150")
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.take_until_overflow(archive(spark, d), ["conv"], ["idx"], 150).select("conv", "idx", "used")


@query(
    "gr02_take_what_fits",
    """WITH RECURSIVE <archive>, o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY idx) AS k FROM archive),
       f AS (SELECT conv, 0::BIGINT AS k, 0::BIGINT AS used, NULL::VARCHAR AS rid FROM (SELECT DISTINCT conv FROM archive)
             UNION ALL SELECT o.conv, o.k, CASE WHEN f.used + o.tokens > 150 THEN f.used ELSE f.used + o.tokens END, CASE WHEN f.used + o.tokens > 150 THEN NULL ELSE o.rid END FROM f JOIN o ON o.conv = f.conv AND o.k = f.k + 1)
       SELECT conv, rid FROM f WHERE rid IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.take_what_fits(archive(spark, d), ["conv"], ["idx"], 150)


@query("gr03_oldest_until", "WITH <archive>, b AS (SELECT conv, idx, tokens, coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM archive), c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv) AS saved FROM b WHERE before < 100) SELECT conv, idx, saved::BIGINT AS saved FROM c WHERE saved >= 60")
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.oldest_until(archive(spark, d), ["conv"], ["idx"], F.lit(100), "tokens", 60).select("conv", "idx", "saved")


@query("gr04_largest_until_fit", "WITH <archive>, b AS (SELECT conv, idx, tokens, coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY tokens DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER (PARTITION BY conv) - 200 AS excess, sum(tokens) OVER (PARTITION BY conv) AS whole FROM archive) SELECT conv, idx, tokens FROM b WHERE excess > 0 AND whole >= excess AND before < excess")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d).withColumn("excess", F.sum("tokens").over(Window.partitionBy("conv")) - 200)
    return budget.largest_until_fit(rows, ["conv"], "tokens", ["idx"], F.col("excess")).select("conv", "idx", "tokens")


@query("gr05_text_within", "SELECT doc_id, length(kept) AS n, CAST(floor(length(kept) / 3.5 + 0.5) AS BIGINT) AS tokens FROM (SELECT doc_id, left(text, CAST(ceil(100.5 * 3.5) AS INT) - 1) AS kept FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    kept = budget.text_within(F.col("text"), 100)
    return read(spark, d, "documents").select("doc_id", F.length(kept).alias("n"), X.estimate_tokens(kept).alias("tokens"))


@query("ta01_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 3.5 + 0.5) AS BIGINT) AS tokens, CAST(floor(CAST(floor(length(text) / 3.5 + 0.5) AS BIGINT) * 1.25 + 0.5) AS BIGINT) AS scaled FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = X.estimate_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", raw.alias("tokens"), X.scaled_tokens(raw, 1.25).alias("scaled"))


@query("ta03_message_cost", "WITH <archive> SELECT conv, (sum(6 + tokens + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END) + 3)::BIGINT AS prompt FROM archive GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    cost = 6 + F.col("tokens") + F.when(F.col("role") == "assistant", 4).otherwise(0)
    return archive(spark, d).groupBy("conv").agg((F.sum(cost) + 3).alias("prompt"))


@query(
    "ta05_calibration",
    f"""WITH RECURSIVE o AS (SELECT source, floor(length(text) / 3.5 + 0.5) + 900 AS e, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) * 2 + 700 AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
      f AS (SELECT source, 0::BIGINT AS k, 1.0::DOUBLE AS pending, 1.0::DOUBLE AS scale, 0 AS n FROM (SELECT DISTINCT source FROM documents)
            UNION ALL SELECT o.source, o.k, CASE WHEN ok THEN p ELSE f.pending END, CASE WHEN NOT ok THEN f.scale WHEN f.n + 1 >= 5 THEN p ELSE greatest(f.scale, p) END, f.n + ok::INT
            FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1,
            LATERAL (SELECT coalesce(o.e > 1000 AND o.r / o.e BETWEEN 0.25 AND 4, FALSE) AS ok, greatest(0.5::DOUBLE, least(2.0::DOUBLE, f.pending * (0.7::DOUBLE + 0.3::DOUBLE * (o.r / o.e)))) AS p))
    SELECT source, arg_max(n, k) AS n_accepted, round(arg_max(scale, k), 9) AS scale FROM f GROUP BY source""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    samples = read(spark, d, "documents").select("source", "doc_id", (X.estimate_tokens(F.col("text")) + 900).alias("estimated"), (F.size(X.words(F.col("text"))) * 2 + 700).alias("real"))
    return budget.calibrated_scale(samples, ["source"], "doc_id")


@query("ta06_window_clamp", "SELECT doc_id, CASE WHEN p + 512 + 64 <= 2048 THEN 512 WHEN 2048 - p - 64 >= 1 THEN 2048 - p - 64 END AS max_tokens, CASE WHEN p + 512 + 64 <= 2048 THEN 'fits' WHEN 2048 - p - 64 >= 1 THEN 'lowered' ELSE 'refused' END AS status FROM (SELECT doc_id, CAST(floor(length(text) / 3.5 + 0.5) AS BIGINT) AS p FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    room = 2048 - X.estimate_tokens(F.col("text")) - 64
    return read(spark, d, "documents").select("doc_id", F.when(room >= 1, F.least(F.lit(512), room)).alias("max_tokens"), F.when(room >= 512, "fits").when(room >= 1, "lowered").otherwise("refused").alias("status"))


@query("ta07_response_budget", "SELECT doc_id, greatest(greatest(1, least(greatest(256, least(512, 400)), 8192 // 4)), least(512, 8192 - p - 128 - 8)) AS response FROM (SELECT doc_id, CAST(floor(length(text) / 3.5 + 0.5) AS BIGINT) AS p FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    floor = max(1, min(max(256, min(512, 400)), 8192 // 4))
    return read(spark, d, "documents").select("doc_id", F.greatest(F.lit(floor).cast("long"), F.least(F.lit(512).cast("long"), 8192 - X.estimate_tokens(F.col("text")) - 128 - 8)).alias("response"))


@query("ta09_truncation", "SELECT doc_id FROM (SELECT doc_id, CAST(floor(length(text) / 3.5 + 0.5) AS BIGINT) AS e, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS r FROM documents) WHERE e >= 1024 AND r > 0 AND r < 0.8 * e")
def _(spark: SparkSession, d: str) -> DataFrame:
    est, real = X.estimate_tokens(F.col("text")), F.size(X.words(F.col("text")))
    return read(spark, d, "documents").where((est >= 1024) & (real > 0) & (real < 0.8 * est)).select("doc_id")


@query(
    "mk01_mask_candidates",
    """WITH <archive>, a AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS age,
       coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 60 AS protected FROM archive)
       SELECT conv, idx, tokens - 20 AS saving FROM a WHERE tokens >= 40 AND age >= 2 AND NOT protected AND role = 'assistant' AND tokens > 20""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.mask_candidates(archive(spark, d), ["conv"], 60, 40, 2, 20).select("conv", "idx", "saving")


@query("mk04_masked_prompt", "WITH <archive> SELECT conv, idx, CASE WHEN tokens > 100 AND role = 'assistant' THEN '[hidden ' || rid || ', ' || tokens || ' tokens]' ELSE content END AS shown FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    masks = rows.where("tokens > 100 AND role = 'assistant'").select("rid", F.concat(F.lit("[hidden "), "rid", F.lit(", "), "tokens", F.lit(" tokens]")).alias("receipt")).dropDuplicates(["rid"])
    return rows.join(masks, "rid", "left").select("conv", "idx", F.coalesce("receipt", "content").alias("shown"))


@query("mk05_shortened", "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 160) || '…' ELSE text END AS short FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 160), F.lit("…"))).otherwise(F.col("text")).alias("short"))


@query("mk06_mask_cost", "WITH <archive> SELECT conv, round(CASE WHEN sum(CASE WHEN role = 'assistant' THEN tokens END) > 0 THEN sum(tokens)::DOUBLE / sum(CASE WHEN role = 'assistant' THEN tokens END) END, 3) AS ratio FROM archive GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = F.sum(F.when(F.col("role") == "assistant", F.col("tokens")))
    return archive(spark, d).groupBy("conv").agg(F.round(F.try_divide(F.sum("tokens"), own), 3).alias("ratio"))


@query(
    "seg02_segment_cut",
    """WITH <archive>, t AS (SELECT *, sum(tokens) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail, lag(role) OVER (PARTITION BY conv ORDER BY idx) AS before FROM archive)
       SELECT conv, coalesce(min(idx) FILTER (tail <= 120 AND role = 'user'), min(idx) FILTER (tail <= 120 AND role = 'assistant' AND before IN ('user', 'tool')), max(idx)) AS cut, arg_max(tail, idx)::BIGINT AS last_tail FROM t WHERE idx > 0 GROUP BY conv""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.segment_cut(archive(spark, d), ["conv"], 120)


@query("seg03_segment_index", "WITH <archive>, u AS (SELECT *, sum(12) OVER (PARTITION BY conv ORDER BY idx DESC) AS used FROM archive) SELECT conv, string_agg(rid || ' ' || role, chr(10) ORDER BY idx DESC) AS listing FROM u WHERE used <= 48 GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = budget.take_until_overflow(archive(spark, d).withColumn("cost", F.lit(12)), ["conv"], [F.col("idx").desc()], 48, "cost")
    entries = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.concat_ws(" ", "rid", "role").alias("e"))), asc=False), lambda x: x["e"])
    return rows.groupBy("conv").agg(F.array_join(entries, "\n").alias("listing"))


@query("hash_chain", "SELECT conv_id, sha256(string_agg(text, '|' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(texts, "|"), 256).alias("h"))


_LE8 = " || ".join(f"substr(n, {15 - 2 * i}, 2)" for i in range(8))


@query("framed_hash_chain", f"SELECT conv_id, sha256(unhex(string_agg({_LE8} || h, '' ORDER BY turn))) AS h FROM (SELECT conv_id, turn, lpad(printf('%x', strlen(text)), 16, '0') AS n, hex(encode(text)) AS h FROM conversations) GROUP BY conv_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return read(spark, d, "conversations").groupBy("conv_id").agg(X.framed_hash(texts).alias("h"))


# Text functions over outputs that events stand for
_OUT = """outs AS (SELECT event_id, op, path, failed, CASE event_type WHEN 'signup' THEN 'Successfully wrote ' || CAST(value AS INT) || ' bytes' WHEN 'purchase' THEN 'Updated ' || path WHEN 'view' THEN 'line one' || chr(10) || 'line two'
  WHEN 'error' THEN 'start' || chr(10) || 'TypeError: boom' || chr(10) || 'Command exited with code ' || (1 + event_id % 3) ELSE '# pass ' || event_id % 12 || chr(10) || '# fail 0' END AS out FROM ops)"""


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    kind = read(spark, d, "events").select("event_id", "event_type")
    out = F.expr(
        """CASE event_type WHEN 'signup' THEN concat('Successfully wrote ', CAST(round(value) AS INT), ' bytes') WHEN 'purchase' THEN concat('Updated ', path) WHEN 'view' THEN 'line one\\nline two'
        WHEN 'error' THEN concat('start\\nTypeError: boom\\nCommand exited with code ', 1 + event_id % 3) ELSE concat('# pass ', event_id % 12, '\\n# fail 0') END"""
    )
    return file_ops(spark, d).join(kind, "event_id").select("event_id", "op", "path", "failed", out.alias("out"))


_OUT_SQL = "WITH <ops>, " + _OUT.replace("CAST(value AS INT)", "CAST(round(value) AS INT)")


@query("tx01_outcome", _OUT_SQL + r" SELECT event_id, CASE WHEN failed OR regexp_matches(out, '\bError:|exited with code [1-9]|(?m)^Error') THEN 'failed' WHEN regexp_matches(out, '^\s*(Successfully|Created|Updated|Wrote|OK\b)') OR (op = 'read' AND trim(out) <> '') THEN 'succeeded' ELSE 'unverified' END AS outcome FROM outs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d).select("event_id", X.outcome(F.col("op"), F.col("out"), F.col("failed")).alias("outcome"))


@query("tx02_receipt", _OUT_SQL + " SELECT event_id, op || ' ' || path || ': ' || left(regexp_replace(out, '\\s+', ' ', 'g'), 40) || CASE WHEN length(out) > 40 THEN '…' ELSE '' END AS receipt FROM outs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d).select("event_id", F.concat("op", F.lit(" "), "path", F.lit(": "), X.squeeze(F.col("out"), 40)).alias("receipt"))


@query("tx03_exit_code", _OUT_SQL + r" SELECT event_id, TRY_CAST(list_extract(regexp_extract_all(out, '(?i)(?:exited with code |exit(?:ed)? (?:status|code)[:= ]+)(\d+)', 1), -1) AS INT) AS code FROM outs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d).select("event_id", X.exit_code(F.col("out")).alias("code"))


@query("tx04_test_counts", _OUT_SQL + r" SELECT event_id, TRY_CAST(list_extract(regexp_extract_all(out, '(?m)^# pass (\d+)', 1), -1) AS INT) AS passed, TRY_CAST(list_extract(regexp_extract_all(out, '(?m)^# fail (\d+)', 1), -1) AS INT) AS failed FROM outs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d).select("event_id", X.test_counts(F.col("out")).alias("t")).select("event_id", "t.passed", "t.failed")


@query("tx05_error_type", _OUT_SQL + r" SELECT event_id, regexp_extract(out, '\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\b', 1) AS error_type, string_split(out, chr(10))[-1] AS last_line, string_split(out, chr(10))[1] AS first_line FROM outs")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("out")
    return _outputs(spark, d).select("event_id", X.error_type(o).alias("error_type"), X.last_line(o).alias("last_line"), X.first_line(o).alias("first_line"))


@query("tx06_output_kind", _OUT_SQL + " SELECT event_id, CASE op WHEN 'write' THEN 'write' WHEN 'edit' THEN 'edit' WHEN 'read' THEN 'read' ELSE CASE WHEN contains(out, '# pass') THEN 'test' ELSE 'shell_error' END END AS kind FROM outs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d).select("event_id", X.output_kind(F.col("op"), F.col("out"), F.col("failed")).alias("kind"))


_ERROR_OUTPUT = "'Error|error|ERR!|Traceback|failed|FAIL|not found|No such file|denied|Cannot|cannot|Unexpected|undefined|exception'"


@query(
    "tx08_last_error_lines",
    """WITH l AS (SELECT doc_id, trim(u.line) AS line, u.pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u),
       e AS (SELECT *, regexp_matches(line, """
    + _ERROR_OUTPUT
    + """) AS bad FROM l WHERE line <> '' AND NOT regexp_matches(line, '(?i)(?:exited with code |exit(?:ed)? (?:status|code)[:= ]+)(\\d+)')),
       p AS (SELECT *, bool_or(bad) OVER (PARTITION BY doc_id) AS failing FROM e), g AS (SELECT doc_id, line, min(pos) AS pos, count(*) AS n FROM p WHERE bad OR NOT failing GROUP BY doc_id, line)
       SELECT doc_id, line, n FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 4""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(F.transform(X.lines(F.col("text")), lambda x: F.btrim(x))).alias("pos", "line"))
    rows = rows.where(F.col("line") != "").where(~F.col("line").rlike(X.EXIT)).withColumn("bad", F.col("line").rlike(X.ERROR_OUTPUT))
    rows = rows.withColumn("failing", F.max("bad").over(Window.partitionBy("doc_id"))).where("bad OR NOT failing")
    unique = rows.groupBy("doc_id", "line").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    return unique.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("pos")))).where("at <= 4").select("doc_id", "line", "n")


@query("tx09_size_text", "SELECT doc_id, (len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END) || ' lines/' || CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE printf('%.1f', strlen(text) / 1024.0) || ' KB' END AS size FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.size_text(F.col("text")).alias("size"))


@query("tx12_conclusion", "SELECT doc_id, left(regexp_replace(trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1]), '\\s+', ' ', 'g'), 200) AS conclusion FROM documents WHERE trim(replace(text, chr(10), '')) <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where(F.btrim(F.replace("text", F.lit("\n"), F.lit(""))) != "")
    return rows.select("doc_id", F.substring(X.last_line(F.col("text"), 100_000), 1, 200).alias("conclusion"))


# Semi-structured records
@query("lf05_markdown_rows", "WITH <ops>, t AS (SELECT conv, '| op | path | n |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || op || ' | ' || path || ' | ' || idx || ' |', chr(10) ORDER BY idx) AS body, count(*) AS n FROM ops GROUP BY conv) SELECT conv, CAST(n AS INT) AS n_rows, 3 AS n_columns FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat(F.lit("| "), "op", F.lit(" | "), "path", F.lit(" | "), "idx", F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", row.alias("r")))), lambda x: x["r"])
    tables = file_ops(spark, d).groupBy("conv").agg(F.concat(F.lit("| op | path | n |\n|---|---|---|\n"), F.array_join(rows, "\n")).alias("body"))
    units = records.markdown_rows(tables, "conv", "body")
    return units.groupBy("conv").agg(F.count("*").cast("int").alias("n_rows"), F.max("n_columns").alias("n_columns"))


@query("lf07_csv_records", "WITH <ops> SELECT conv, idx, op, path FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    row = F.concat_ws(",", "idx", "op", "path")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", row.alias("r")))), lambda x: x["r"])
    tables = file_ops(spark, d).groupBy("conv").agg(F.concat(F.lit("idx,op,path\n"), F.array_join(rows, "\n")).alias("body"))
    units = records.csv_records(tables, "conv", "body")
    return units.select("conv", F.element_at("fields", 1).cast("int").alias("idx"), F.element_at("fields", 2).alias("op"), F.element_at("fields", 3).alias("path"))


@query("lf12_log_records", "WITH <ops> SELECT conv, idx, CASE WHEN failed THEN 2 ELSE 1 END AS n_lines FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Records of every conversation's log: what is written here is a log for sure, so no share of stamped lines or number of lines is asked for."""
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("0000-00-00 00:00:00"))
    line = F.concat(F.concat_ws(" ", stamp, "op", "idx"), F.when(F.col("failed"), F.lit("\n  at here")).otherwise(F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("r")))), lambda x: x["r"])
    logs = file_ops(spark, d).groupBy("conv").agg(F.array_join(rows, "\n").alias("body"))
    units = records.log_records(logs, "conv", "body", least_stamped=0, least_lines=1)
    return units.select("conv", (F.col("unit") - 1).alias("idx"), F.col("n_lines").cast("int").alias("n_lines"))


@query("lf15_leaf_rank", "WITH l AS (SELECT doc_id, u.line, u.pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u), t AS (SELECT doc_id, pos, " + TERMS.format("line") + " AS toks FROM l), s AS (SELECT doc_id, count(*) AS n, avg(len(toks)) AS avgdl FROM t GROUP BY doc_id), h AS (SELECT t.doc_id, pos, term, len(list_filter(toks, lambda x: x = term)) AS f, len(toks) AS dl FROM t, (VALUES ('the'), ('der'), ('que')) v(term)), d AS (SELECT doc_id, term, count(*) AS df FROM h WHERE f > 0 GROUP BY ALL) SELECT doc_id, pos, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN d USING (doc_id, term) JOIN s USING (doc_id) WHERE f > 0 GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("pos"), "line")
    return records.rank_units(units, "doc_id", "pos", "line", ["the", "der", "que"])


@query("lf_units")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Texts are those of a user and day, in pieces of about UNIT_CHARS: no row holds all of a user, and none is over the parser's limit unless one line is."""
    keys = ["conv", "day", "piece"]

    def texts(rows: DataFrame, before: str, between: str, after: str) -> DataFrame:
        so_far = F.sum(F.length("line") + len(between)).over(Window.partitionBy("conv", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("day", F.to_date("ts")).withColumn("piece", F.floor(so_far / UNIT_CHARS).cast("long"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))), lambda x: x["line"])
        return rows.groupBy(keys).agg(F.concat(F.lit(before), F.array_join(lines, between), F.lit(after)).alias("body"))

    tables = file_ops(spark, d).select("conv", "ts", "event_id", F.concat_ws(",", "idx", "op", "path").alias("line"))
    props = read(spark, d, "events").where("props IS NOT NULL").select(F.col("user_id").alias("conv"), "ts", "event_id", F.col("props").alias("line"))
    return records.parse_units(texts(tables, "idx,op,path\n", "\n", "").unionByName(texts(props, "[\n", ",\n", "\n]")), keys, "body")


@query("rc10_turn_tree", "WITH <archive>, t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN idx END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY idx) AS turn_idx FROM archive) SELECT conv, turn_idx, count(*) AS n, count(*) FILTER (role = 'assistant') AS replies, sum(tokens)::BIGINT AS tokens, left(arg_min(content, idx), 80) AS opening FROM t GROUP BY conv, turn_idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.turn_of(archive(spark, d), ["conv"], F.col("role") == "user")
    return rows.groupBy("conv", "turn_idx").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("replies"), F.sum("tokens").alias("tokens"), F.substring(F.min_by("content", "idx"), 1, 80).alias("opening"))


@query("rc04_rendered", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid, content, tokens", _CONTENT, "SELECT rid, score, used FROM (SELECT rid, score, sum(tokens) OVER (ORDER BY score DESC, conv, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha1(trim(content)) ORDER BY score DESC, conv, idx) AS dup FROM scored) WHERE dup = 1 ORDER BY score DESC, conv, idx LIMIT 8)) WHERE used <= 600"))
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = _scored(archive(spark, d))
    first = Window.partitionBy(F.sha1(F.btrim("content"))).orderBy(F.desc("score"), "conv", "idx")
    shown = search.top(hits.withColumn("dup", F.row_number().over(first)).where("dup = 1"), 8, "conv", "idx")
    return budget.take_until_overflow(shown.withColumn("_all", F.lit(1)), ["_all"], [F.desc("score"), "conv", "idx"], 600).select("rid", "score", "used")


@query("ss03_latest_total", "WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL) SELECT user_id, count(*) AS n_keys, round(sum(v), 4) AS total FROM l GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    last = lifecycle.latest_versions(read(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "value", "event_id")
    return last.groupBy("user_id").agg(F.count("*").alias("n_keys"), F.round(F.sum("value"), 4).alias("total"))


@query("ss04_idle_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = read(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("started"), "n")
