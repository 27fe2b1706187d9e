"""Recall modes, receipts, planning, stored state and streams over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as X
from convlake.operators import budget, lifecycle, search, structure
from convlake.operators.search_index import SearchIndex
from convlake.plans.registry import FOLD, TERMS, query
from convlake.plans.search_queries import _bm25_sql, _scored, _variant
from convlake.sources import journal_files, scratch
from convlake.sources.archive import archive, file_ops, read
from convlake.streaming import journal

_CONTENT = TERMS.format("content")
_LINES = "l AS (SELECT {key}, u.line, u.pos FROM (SELECT {key}, string_split({text}, chr(10)) AS a FROM {table}) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u)"
_DOC_LINES = _LINES.format(key="doc_id", text="text", table="documents")


@query(
    "jn10_applicable_segment",
    "WITH <archive>, cuts AS (SELECT a.conv, a.idx AS cut_idx, sha256(b.content) AS cut_h, row_number() OVER (PARTITION BY a.conv ORDER BY a.idx) AS seg FROM archive a JOIN archive b ON b.conv = a.conv AND b.idx = a.idx - 1 WHERE a.role = 'user') SELECT c.conv, max(seg) AS seg, arg_max(cut_idx, seg) AS cut_idx FROM cuts c JOIN archive m ON m.conv = c.conv AND m.idx = c.cut_idx - 1 AND sha256(m.content) = c.cut_h GROUP BY c.conv",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    hashed = archive(spark, d).select("conv", "idx", "role", F.sha2("content", 256).alias("h"))
    w = Window.partitionBy("conv").orderBy("idx")
    cuts = hashed.withColumn("cut_h", F.lag("h").over(w)).where("role = 'user' AND idx > 0").select("conv", (F.col("idx") - 1).alias("idx"), F.col("cut_h").alias("h"), F.row_number().over(w).alias("seg"))
    return cuts.join(hashed, ["conv", "idx", "h"]).groupBy("conv").agg(F.max("seg").alias("seg"), (F.max_by("idx", "seg") + 1).alias("cut_idx"))


@query(
    "jn11_longest_prefix",
    "WITH p AS (SELECT doc_id, n, sha256(left(text, n)) AS h FROM documents, (VALUES (50), (200), (800)) v(n) WHERE length(text) >= n), f AS (SELECT n, h, min(doc_id) AS saved FROM p GROUP BY n, h) SELECT p.doc_id, max(p.n) AS longest, arg_max(saved, p.n) AS saved FROM p JOIN f ON f.n = p.n AND f.h = p.h AND f.saved < p.doc_id GROUP BY p.doc_id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.explode(F.filter(F.array(F.lit(50), F.lit(200), F.lit(800)), lambda n: F.length("text") >= n)).alias("n")
    prefixes = read(spark, d, "documents").select("doc_id", "text", sizes).select("doc_id", "n", F.sha2(F.substring(F.col("text"), F.lit(1), F.col("n")), 256).alias("h"))
    first = prefixes.groupBy("n", "h").agg(F.min("doc_id").alias("saved"))
    return prefixes.join(first, ["n", "h"]).where("saved < doc_id").groupBy("doc_id").agg(F.max("n").alias("longest"), F.max_by("saved", "n").alias("saved"))


@query("jn11_saved_prefix", "SELECT a.doc_id, max(length(b.text)) AS longest, arg_min(b.doc_id, b.doc_id - 1e12 * length(b.text)) AS saved FROM documents a JOIN documents b ON b.doc_id < a.doc_id AND length(b.text) > 0 AND starts_with(a.text, b.text) GROUP BY a.doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The whole job of which jn11_longest_prefix and its SQL state three lengths."""
    return structure.saved_prefixes(read(spark, d, "documents"), "doc_id", "text")


@query("jn12_superseded_saves", "SELECT a.doc_id, max(b.doc_id) AS superseded_by FROM documents a JOIN documents b ON b.doc_id > a.doc_id AND length(a.text) > 0 AND starts_with(b.text, a.text) GROUP BY a.doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return structure.superseded(read(spark, d, "documents"), "doc_id", "text")


@query("ag19_weights", "SELECT sum(length(html))::BIGINT AS whole, sum(length(html) - length(regexp_replace(html, '<[^>]*>', '', 'g')))::BIGINT AS frame FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("html")
    return read(spark, d, "pages").agg(F.sum(n).alias("whole"), F.sum(n - F.length(F.regexp_replace("html", "<[^>]*>", ""))).alias("frame"))


@query("ag21_strong_hits", "WITH <archive> SELECT query, count(*) AS n, count(*) FILTER (strong) AS n_strong FROM (SELECT * FROM " + _variant("a", ["the", "tion"]) + " UNION ALL SELECT * FROM " + _variant("b", ["onou", "der"]) + ") GROUP BY query")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = [_scored(archive(spark, d), w).groupBy(F.lit(q).alias("query")).agg(F.count("*").alias("n"), F.count_if(F.col("n_terms") == len(w)).alias("n_strong")) for q, w in (("a", ["the", "tion"]), ("b", ["onou", "der"]))]
    return parts[0].unionByName(parts[1])


@query("st01_exact_then_fts", "WITH <archive> SELECT rid, bool_or(exact) AS exact FROM (SELECT rid, true AS exact FROM archive WHERE contains(content, 'tion') UNION ALL SELECT rid, false FROM archive WHERE list_contains(" + _CONTENT + ", 'the')) GROUP BY rid")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    hits = rows.where(F.contains("content", F.lit("tion"))).select("rid", F.lit(True).alias("exact")).unionByName(rows.where(F.array_contains(X.terms(F.col("content")), "the")).select("rid", F.lit(False).alias("exact")))
    return hits.groupBy("rid").agg(F.max("exact").alias("exact"))


@query("ft14_wide_excerpt", "WITH <archive> SELECT rid, substr(content, greatest(1, instr(lower(content), 'tion') - 400), 1600) AS piece FROM archive WHERE contains(lower(content), 'tion')")
def _(spark: SparkSession, d: str) -> DataFrame:
    at = F.locate("tion", F.lower("content"))
    return archive(spark, d).where(at > 0).select("rid", F.substring(F.col("content"), F.greatest(F.lit(1), at - 400), F.lit(1600)).alias("piece"))


@query("ft16_page", "SELECT doc_id, greatest(1, instr(text, 'tion') - 175) AS starts, length(substr(text, greatest(1, instr(text, 'tion') - 175), 350)) AS n, CASE WHEN greatest(1, instr(text, 'tion') - 175) + 350 <= length(text) THEN greatest(1, instr(text, 'tion') - 175) + 350 END AS next_start FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    start = F.greatest(F.lit(1), F.locate("tion", F.col("text")) - 175)
    page = F.substring(F.col("text"), start, F.lit(350))
    return read(spark, d, "documents").select("doc_id", start.alias("starts"), F.length(page).alias("n"), F.when(start + 350 <= F.length("text"), start + 350).alias("next_start"))


@query(
    "ft17_best_lines",
    "WITH " + _DOC_LINES + ", h AS (SELECT *, 2 * contains(" + FOLD.format("line") + ", 'tion')::INT + contains(" + FOLD.format("line") + ", 'der')::INT AS own FROM l), s AS (SELECT doc_id, pos, own + 0.5 * (own > 0)::INT + coalesce(lead(own) OVER w, 0) + coalesce(lead(own, 2) OVER w, 0) AS score FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 2",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("p", "line"))
    own = 2 * F.contains(X.fold(F.col("line")), F.lit("tion")).cast("int") + F.contains(X.fold(F.col("line")), F.lit("der")).cast("int")
    w = Window.partitionBy("doc_id").orderBy("pos")
    scored = rows.select("doc_id", (F.col("p") + 1).alias("pos"), own.alias("own"))
    scored = scored.withColumn("score", F.col("own") + 0.5 * (F.col("own") > 0).cast("int") + F.coalesce(F.lead("own").over(w), F.lit(0)) + F.coalesce(F.lead("own", 2).over(w), F.lit(0))).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))).where("rank <= 2").select("doc_id", "pos", "score")


@query("ft20_recent_words", "WITH <archive>, r AS (SELECT conv, idx, content, row_number() OVER (PARTITION BY conv ORDER BY idx DESC) AS back FROM archive) SELECT conv, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(lower(content), '[a-z]{6,}'))))), ' ') AS words FROM r WHERE back <= 2 GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("idx")))
    rows = archive(spark, d).withColumn("back", back).where("back <= 2")
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{6,}"), F.lit(0))))))
    return rows.groupBy("conv").agg(F.array_join(found, " ").alias("words"))


@query("ft23_hint", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid", _CONTENT, "SELECT conv, string_agg(rid, ' ' ORDER BY score DESC, idx) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY score DESC, idx) AS rank FROM scored) WHERE rank <= 5 GROUP BY conv"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "idx"))
    best = _scored(archive(spark, d)).withColumn("rank", rank).where("rank <= 5")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "rid"))), lambda x: x["rid"])
    return best.groupBy("conv").agg(F.array_join(ids, " ").alias("ids"))


@query("rc05_path_timeline", "WITH <ops> SELECT conv, idx, op, path, failed, idx = min(idx) FILTER (op = 'write') OVER (PARTITION BY conv, path) AS first_write FROM ops WHERE ends_with(path, 'file7.js')")
def _(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.when(F.col("op") == "write", F.col("idx"))).over(Window.partitionBy("conv", "path"))
    rows = file_ops(spark, d).where(F.col("path").endswith("file7.js"))
    return rows.select("conv", "idx", "op", "path", "failed", (F.col("idx") == first).alias("first_write")).orderBy("conv", "idx")


@query("rc06_first_write_of_path", "WITH <ops>, f AS (SELECT path, arg_min(conv, event_id) AS conv, arg_min(idx, event_id) AS idx FROM ops WHERE op = 'write' GROUP BY path) SELECT * FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return file_ops(spark, d).where("op = 'write'").groupBy("path").agg(F.min_by("conv", "event_id").alias("conv"), F.min_by("idx", "event_id").alias("idx"))


@query("rc08_outputs_of_call", "WITH <ops>, c AS (SELECT conv, idx FROM ops WHERE op = 'write') SELECT o.conv, c.idx AS call_idx, o.idx AS out_idx FROM c JOIN ops o ON o.conv = c.conv AND o.idx = c.idx + 1 WHERE o.op = 'bash'")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv").orderBy("idx")
    rows = file_ops(spark, d).withColumn("before", F.lag("op").over(w)).where("op = 'bash' AND before = 'write'")
    return rows.select("conv", (F.col("idx") - 1).alias("call_idx"), F.col("idx").alias("out_idx"))


@query("rc12_recall_use", "WITH <archive>, w AS (SELECT conv, idx, role, list_distinct(regexp_extract_all(lower(content), '[a-z]{4,}')) AS words, lag(list_distinct(regexp_extract_all(lower(content), '[a-z]{4,}'))) OVER (PARTITION BY conv ORDER BY idx) AS before FROM archive) SELECT conv, idx, len(list_intersect(words, before)) AS shared FROM w WHERE role = 'assistant' AND before IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{4,}"), F.lit(0)))
    rows = archive(spark, d).select("conv", "idx", "role", words.alias("words")).withColumn("before", F.lag("words").over(Window.partitionBy("conv").orderBy("idx")))
    return rows.where("role = 'assistant' AND before IS NOT NULL").select("conv", "idx", F.size(F.array_intersect("words", "before")).alias("shared"))


@query("gr07_free_until_need", "WITH <archive>, o AS (SELECT conv, idx, tokens, coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY CASE role WHEN 'assistant' THEN 0 ELSE 1 END, tokens DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM archive) SELECT conv, idx, tokens FROM o WHERE before < 80")
def _(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("role") == "assistant", 0).otherwise(1)
    return budget.oldest_until(archive(spark, d), ["conv"], [band, F.desc("tokens"), "idx"], F.lit(80), "tokens").select("conv", "idx", "tokens")


@query("ta08_thresholds", "SELECT doc_id, greatest(64, 128, CAST(floor(length(text) * 0.25) AS BIGINT)) AS limit_tokens FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.greatest(F.lit(64), F.lit(128), F.floor(F.length("text") * 0.25)).alias("limit_tokens"))


@query("ta10_rendered_prompt", "WITH <archive> SELECT conv, sha256(string_agg('<|' || role || '|>' || chr(10) || content || chr(10), '' ORDER BY idx)) AS h, count(*) AS n FROM archive GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))), lambda x: x["p"]), "")
    return archive(spark, d).groupBy("conv").agg(F.sha2(text, 256).alias("h"), F.count("*").alias("n"))


@query("mk02_aligned_start", "WITH <archive>, o AS (SELECT conv, idx, coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_token, sum(tokens) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM archive) SELECT conv, min(idx) AS start_idx FROM o WHERE at_token % 64 <= 16 AND tail >= 50 GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = budget.suffix_totals(budget.prefix_offsets(archive(spark, d), ["conv"], ["idx"]), ["conv"], ["idx"])
    return rows.where((F.col("offset") % 64 <= 16) & (F.col("tail") >= 50)).groupBy("conv").agg(F.min("idx").alias("start_idx"))


@query("mk07_stable_frontier", "WITH <archive>, f AS (SELECT conv, min(idx) AS frontier FROM archive WHERE role = 'assistant' AND tokens >= 40 GROUP BY conv) SELECT f.conv, frontier, sum(tokens)::BIGINT AS reread FROM f JOIN archive a ON a.conv = f.conv AND a.idx >= f.frontier GROUP BY f.conv, frontier")
def _(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.when((F.col("role") == "assistant") & (F.col("tokens") >= 40), F.col("idx"))).over(Window.partitionBy("conv"))
    return archive(spark, d).withColumn("frontier", first).where("idx >= frontier").groupBy("conv", "frontier").agg(F.sum("tokens").alias("reread"))


@query("seg04_pins_block", "WITH <archive>, u AS (SELECT conv, idx, content, sum(tokens) OVER (PARTITION BY conv ORDER BY idx DESC) AS used FROM archive WHERE role = 'user') SELECT conv, string_agg('- ' || left(content, 40), chr(10) ORDER BY idx) AS pins FROM u WHERE used <= 120 GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = budget.take_until_overflow(archive(spark, d).where("role = 'user'"), ["conv"], [F.desc("idx")], 120)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(F.lit("- "), F.substring("content", 1, 40)).alias("e")))), lambda x: x["e"])
    return rows.groupBy("conv").agg(F.array_join(entries, "\n").alias("pins"))


@query("seg06_branches", "WITH <archive>, h AS (SELECT conv, idx, sha256(content) AS h FROM archive WHERE idx = 0), s AS (SELECT h, count(*) AS n FROM h GROUP BY h) SELECT conv, n > 1 AS branched FROM h JOIN s USING (h)")
def _(spark: SparkSession, d: str) -> DataFrame:
    first = archive(spark, d).where("idx = 0").select("conv", F.sha2("content", 256).alias("h"))
    return first.join(first.groupBy("h").agg(F.count("*").alias("n")), "h").select("conv", (F.col("n") > 1).alias("branched"))


@query("seg07_anchor_hash", "WITH <archive> SELECT conv, sha256(string_agg(content, chr(10) ORDER BY idx)) AS anchor FROM archive WHERE idx < 2 GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"])
    return archive(spark, d).where("idx < 2").groupBy("conv").agg(F.sha2(F.array_join(texts, "\n"), 256).alias("anchor"))


@query("tx07_typed_receipt", "WITH <ops> SELECT event_id, CASE op WHEN 'write' THEN 'wrote ' || path WHEN 'edit' THEN 'edited ' || path WHEN 'read' THEN 'read ' || path ELSE CASE WHEN failed THEN 'command failed' ELSE 'command succeeded' END END || ' #' || left(sha256(path), 12) AS receipt FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    done = F.when(F.col("op") == "write", F.concat(F.lit("wrote "), "path")).when(F.col("op") == "edit", F.concat(F.lit("edited "), "path")).when(F.col("op") == "read", F.concat(F.lit("read "), "path"))
    done = done.otherwise(F.when(F.col("failed"), F.lit("command failed")).otherwise(F.lit("command succeeded")))
    return file_ops(spark, d).select("event_id", F.concat(done, F.lit(" #"), F.substring(F.sha2("path", 256), 1, 12)).alias("receipt"))


@query("tx10_shortened_sentences", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_extract(text, '^(?s:.{0,119}[.])', 0) END AS short FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.when(F.length("text") <= 120, F.col("text")).otherwise(F.regexp_extract("text", "^(?s:.{0,119}[.])", 0)).alias("short"))


@query("tx11_fingerprint", "SELECT user_id, left(sha256(string_agg(event_type, chr(0) ORDER BY event_type)), 16) AS fingerprint FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("event_type")), "\0"), 256), 1, 16).alias("fingerprint"))


@query("tx13_piece_value", "WITH <archive> SELECT rid, CASE WHEN role = 'system' THEN 3 WHEN role = 'user' THEN 2 WHEN tokens > 100 THEN 0 ELSE 1 END AS band, round(len(regexp_extract_all(content, '[A-Z]')) / (tokens + 1.0), 6) AS value FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("role") == "system", 3).when(F.col("role") == "user", 2).when(F.col("tokens") > 100, 0).otherwise(1)
    return archive(spark, d).select("rid", band.alias("band"), F.round(F.regexp_count("content", F.lit("[A-Z]")) / (F.col("tokens") + 1.0), 6).alias("value"))


@query("tx15_names", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE 'other' END AS language FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ["en", "English", "de", "German", "fr", "French", "es", "Spanish"]))
    return read(spark, d, "documents").select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("other")).alias("language"))


@query("lf18_faithful", "WITH " + _DOC_LINES + " SELECT doc_id, count(*) AS n_lines, bool_and(true) AS faithful FROM l GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "text", F.posexplode(X.lines(F.col("text"))).alias("p", "line"))
    again = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), (again == F.first("text")).alias("faithful"))


@query("kv03_verified", "SELECT doc_id, sha256(text) AS sha, true AS verified FROM documents WHERE length(text) > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("length(text) > 0")
    n = F.ceil(F.length("text") / 1000).cast("int")
    parts = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 1000 + 1, F.lit(1000)))).alias("pos", "block"))
    rebuilt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "")
    return parts.groupBy("doc_id", "sha").agg(F.sha2(rebuilt, 256).alias("again")).select("doc_id", "sha", (F.col("again") == F.col("sha")).alias("verified"))


@query("kv04_archive_candidates", "WITH r AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS newest FROM documents) SELECT source, doc_id FROM r WHERE newest > 1 AND n >= 2000")
def _(spark: SparkSession, d: str) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return read(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"), newest.alias("newest")).where("newest > 1 AND n >= 2000").select("source", "doc_id")


@query("fg02_json_belongs", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(spark: SparkSession, d: str) -> DataFrame:
    values = F.map_values(F.from_json("props", "map<string,string>"))
    return read(spark, d, "events").where(F.array_contains(values, "7")).select("event_id")


@query("bm02_auto_bench", "WITH <archive>, h AS (SELECT conv, bool_or(contains(lower(content), 'tion')) AS fired, count(*) FILTER (contains(lower(content), 'tion')) AS hits, sum(tokens) FILTER (contains(lower(content), 'tion')) AS tokens FROM archive GROUP BY conv) SELECT count(*) AS questions, count(*) FILTER (fired) AS fired, count(*) FILTER (hits >= 2) AS two_or_more, round(avg(tokens) FILTER (fired), 6) AS mean_tokens FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains(F.lower("content"), F.lit("tion"))
    per = archive(spark, d).groupBy("conv").agg(F.max(hit).alias("fired"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, F.col("tokens"))).alias("tokens"))
    return per.agg(F.count("*").alias("questions"), F.count_if("fired").alias("fired"), F.count_if(F.col("hits") >= 2).alias("two_or_more"), F.round(F.avg(F.when(F.col("fired"), F.col("tokens"))), 6).alias("mean_tokens"))


@query("rm02_active_lists", "WITH <archive> SELECT conv, string_agg(idx::VARCHAR, ',' ORDER BY idx DESC) AS segments FROM archive WHERE role = 'user' GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).where("role = 'user'").groupBy("conv").agg(F.array_join(F.sort_array(F.collect_list("idx"), asc=False), ",").alias("segments"))


@query("rm03_deleted_keys", "WITH <archive> SELECT conv, idx FROM archive a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.conv AND l.toxic = 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    gone = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv"))
    return archive(spark, d).join(gone, "conv", "left_anti").select("conv", "idx")


@query("rm04_suffixed_keys", "WITH <archive>, k AS (SELECT rid || s AS k, rid FROM archive, (VALUES (''), (':think'), (':args'), (':drop')) v(s)) SELECT rid, count(*) AS n_keys FROM k WHERE k NOT LIKE '%:drop' GROUP BY rid")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = archive(spark, d).select("rid", F.explode(F.array(*(F.concat("rid", F.lit(s)) for s in ("", ":think", ":args", ":drop")))).alias("k"))
    return keys.where(~F.col("k").endswith(":drop")).groupBy("rid").agg(F.count("*").alias("n_keys"))


@query("rm07_sticky_choice", "WITH <archive>, f AS (SELECT conv, arg_min(role, idx) AS chosen FROM archive GROUP BY conv) SELECT a.conv, a.idx, coalesce(f.chosen, 'user') AS chosen FROM archive a LEFT JOIN f USING (conv)")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return archive(spark, d).select("conv", "idx", F.coalesce(F.first("role").over(w), F.lit("user")).alias("chosen"))


@query("rm12_command_text", "SELECT event_id, 'run ' || event_type || ' ' || json_extract_string(props, '$.k') AS command FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    argv = F.to_json(F.array(F.lit("run"), F.col("event_type"), F.get_json_object("props", "$.k")))
    return read(spark, d, "events").select("event_id", F.array_join(F.from_json(argv, "array<string>"), " ").alias("command"))


@query("rm13_indents", "WITH " + _DOC_LINES + " SELECT doc_id, pos, length(line) - length(ltrim(line)) AS indent, trim(line) = '' AS blank FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("p", "line"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), (F.length("line") - F.length(F.ltrim("line"))).alias("indent"), (F.trim("line") == "").alias("blank"))


@query("rm17_rounds", "WITH <archive> SELECT conv, idx, sum((role = 'assistant')::INT) OVER (PARTITION BY conv ORDER BY idx)::BIGINT AS round_no FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return structure.islands(archive(spark, d), ["conv"], ["idx"], F.col("role") == "assistant").select("conv", "idx", F.col("island").alias("round_no"))


@query("rm18_trim_newest_group", "WITH <archive>, g AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv ORDER BY idx) AS grp FROM archive), t AS (SELECT conv, grp, sum(tokens) AS tokens FROM g GROUP BY conv, grp), u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv ORDER BY grp) AS used FROM t) SELECT conv, grp, used::BIGINT AS used FROM u WHERE used <= 300")
def _(spark: SparkSession, d: str) -> DataFrame:
    groups = structure.islands(archive(spark, d), ["conv"], ["idx"], F.col("role") == "user").groupBy("conv", F.col("island").alias("grp")).agg(F.sum("tokens").alias("tokens"))
    return budget.take_until_overflow(groups, ["conv"], ["grp"], 300).select("conv", "grp", "used")


@query("rm19_question_words", "WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')) AS w FROM benchmark), c AS (SELECT list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{8,}')))) AS known FROM conversations) SELECT item_id, len(list_intersect(w, known)) AS present FROM b, c")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = lambda: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))
    asked = read(spark, d, "benchmark").select("item_id", F.explode_outer(words()).alias("w"))
    known = read(spark, d, "conversations").select(F.explode(words()).alias("w")).distinct().withColumn("hit", F.lit(1))
    return asked.join(known, "w", "left").groupBy("item_id").agg(F.count("hit").alias("present"))


@query("rm22_tables_with_conversation", "SELECT 'conversations' AS table_name, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: read(spark, d, n) for n in ("conversations", "documents", "events", "labels")}
    found = [df.where("conv_id IS NOT NULL").agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, df in tables.items() if "conv_id" in df.columns]
    return found[0]


@query("rm24_merged_head", "WITH <archive>, r AS (SELECT *, min(CASE WHEN role <> 'system' THEN idx END) OVER (PARTITION BY conv) AS first_other FROM archive) SELECT conv, coalesce(string_agg(content, chr(10) ORDER BY idx) FILTER (role = 'system' AND idx < first_other), '') AS head, max(idx) FILTER (role = 'user') AS last_query FROM r GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    other = F.min(F.when(F.col("role") != "system", F.col("idx"))).over(Window.partitionBy("conv"))
    rows = archive(spark, d).withColumn("other", other)
    head = F.when((F.col("role") == "system") & (F.col("idx") < F.col("other")), F.struct("idx", "content"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(head)), lambda x: x["content"]), "\n")
    return rows.groupBy("conv").agg(text.alias("head"), F.max(F.when(F.col("role") == "user", F.col("idx"))).alias("last_query"))


@query("rm26_context_size", "SELECT user_id, coalesce(max(value) FILTER (event_type = 'signup' AND event_id % 7 = 0), CASE WHEN count(DISTINCT event_type) = 1 THEN max(value) END, min(value)) AS picked FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    exact = F.max(F.when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), F.col("value")))
    single = F.when(F.count_distinct("event_type") == 1, F.max("value"))
    return read(spark, d, "events").groupBy("user_id").agg(F.coalesce(exact, single, F.min("value")).alias("picked"))


@query("rm27_alias_join", "WITH a AS (SELECT 'write' AS id, ['signup', 'purchase'] AS aliases UNION ALL SELECT 'look', ['view', 'click']) SELECT event_id, coalesce(a.id, 'unknown') AS resolved FROM events LEFT JOIN a ON list_contains(aliases, event_type)")
def _(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("write", ["signup", "purchase"]), ("look", ["view", "click"])], "id string, aliases array<string>").select("id", F.explode("aliases").alias("event_type"))
    return read(spark, d, "events").join(F.broadcast(aliases), "event_type", "left").select("event_id", F.coalesce("id", F.lit("unknown")).alias("resolved"))


@query("rm28_file_report", "WITH <ops> SELECT path, count(*) AS n, count(DISTINCT conv) AS conversations, count(*) FILTER (failed) AS failures, min(idx) AS first_idx, max(idx) AS last_idx FROM ops GROUP BY path")
def _(spark: SparkSession, d: str) -> DataFrame:
    return file_ops(spark, d).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("conv").alias("conversations"), F.count_if("failed").alias("failures"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("rm29_speed_up", "SELECT event_type, round(median(value) FILTER (ts < TIMESTAMP '2024-01-15') / median(value) FILTER (ts >= TIMESTAMP '2024-01-15'), 6) AS speed_up FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.try_divide(F.median(F.when(early, F.col("value"))), F.median(F.when(~early, F.col("value")))), 6).alias("speed_up"))


@query("rm30_rankings_compared", "WITH <archive>, r AS (SELECT rid, conv, idx, row_number() OVER (PARTITION BY conv ORDER BY tokens DESC, idx) AS old_rank, row_number() OVER (PARTITION BY conv ORDER BY idx) AS new_rank FROM archive) SELECT conv, count(*) FILTER (old_rank <> new_rank) AS moved, max(abs(old_rank - new_rank)) AS farthest FROM r GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    old = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("tokens"), "idx"))
    new = F.row_number().over(Window.partitionBy("conv").orderBy("idx"))
    rows = archive(spark, d).select("conv", old.alias("old"), new.alias("new"))
    return rows.groupBy("conv").agg(F.count_if(F.col("old") != F.col("new")).alias("moved"), F.max(F.abs(F.col("old") - F.col("new"))).alias("farthest"))


@query(
    "wn11_prune_by_size",
    """WITH RECURSIVE o AS (SELECT source, doc_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents),
       f AS (SELECT source, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS taken, NULL::BIGINT AS doc_id FROM (SELECT DISTINCT source FROM documents)
             UNION ALL SELECT o.source, o.k, f.used + CASE WHEN fits THEN o.n ELSE 0 END, f.taken + fits::INT, CASE WHEN fits THEN o.doc_id END
             FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1, LATERAL (SELECT f.used + o.n <= 12000 AND f.taken < 5 AS fits))
       SELECT source, doc_id FROM f WHERE doc_id IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return budget.take_what_fits(rows, ["source"], [F.desc("doc_id")], 12000, "n", "doc_id", most=5)


@query("ss01_journal_stream", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The journal is read as a stream to its end and what arrived is counted."""
    out = scratch.folder(spark, "journal")
    rows = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    journal.drain(rows.select("event_id", "event_type", "value"), f"{out}-progress", out)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("sc08_journal_reader", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The events as journals of JSON lines, read by two starts of one query: the second finds what came after the first."""
    folder, rows = scratch.folder(spark, "journals"), read(spark, d, "events").select("event_id", "event_type", "value")
    for bound in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        rows.where(bound).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{folder}/files")
        events = journal_files.journal_events(journal_files.journal_lines(spark, f"{folder}/files/part-", 1 << 20), rows.schema.simpleString()[7:-1].replace(":", " "))
        journal.drain(events.drop("file", "offset"), f"{folder}/progress", f"{folder}/events")
    return spark.read.parquet(f"{folder}/events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("event_id").alias("n_ids"))


@query("ss08_search_state", "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS most FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", F.max("value").over(Window.partitionBy("user_id").orderBy("event_id")).alias("most"))


@query("ss09_incremental_index", "WITH <archive>, b AS (SELECT CASE WHEN idx < 1 THEN 1 WHEN idx < 3 THEN 2 ELSE 3 END AS batch FROM archive) SELECT v.batch, count(b.batch) AS new_pieces, (SELECT count(*) FROM archive) AS texts FROM (VALUES (1), (2), (3), (4)) v(batch) LEFT JOIN b USING (batch) GROUP BY v.batch")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, index = archive(spark, d), SearchIndex(spark, scratch.folder(spark, "search-index"), window=None)
    batches = [(k + 1, index.ensure(rows.where(bound))) for k, bound in enumerate(["idx < 1", "idx < 3", "true", "true"])]
    return spark.createDataFrame([(k, n, sum(r.texts for r in index.manifest())) for k, n in batches], "batch int, new_pieces long, texts long")


@query("ss11_new_failures", "SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type = 'error' AND before IS DISTINCT FROM 'error'")
def _(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, d, "events").withColumn("before", before).where((F.col("event_type") == "error") & ~F.col("before").eqNullSafe("error")).select("event_id", "user_id")


@query("rc02_legacy_recall", "WITH <archive>, " + _bm25_sql("archive", "conv, idx, rid", _CONTENT, "SELECT rid, min(src) AS src FROM (SELECT rid, 0 AS src FROM archive WHERE contains(content, 'tion') UNION ALL SELECT rid, 1 FROM scored) GROUP BY rid"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    both = rows.where(F.contains("content", F.lit("tion"))).select("rid", F.lit(0).alias("src")).unionByName(search.bm25(rows, ["the", "tion", "der", "onou"]).select("rid", F.lit(1).alias("src")))
    return both.groupBy("rid").agg(F.min("src").alias("src"))
