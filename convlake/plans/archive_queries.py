"""Scans, filters, joins, aggregates, windows and set operations over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import text as X
from convlake.operators import budget, lifecycle, structure
from convlake.operators.search_index import SearchIndex
from convlake.plans.registry import query
from convlake.sources.archive import PIECES, archive, document_archive, file_ops, read, read_or_empty
from convlake.sources.scratch import folder


# Scans, sources and sinks
@query("sc01_point_lookup", "WITH <archive> SELECT conv, idx, rid, content FROM archive WHERE conv = 3 AND rid = (SELECT min(rid) FROM archive WHERE conv = 3)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d).where("conv = 3")
    wanted = rows.agg(F.min("rid").alias("rid"))
    return rows.join(F.broadcast(wanted), "rid").select("conv", "idx", "rid", "content")


@query("sc02_range_scan", "WITH <archive> SELECT conv, idx, role, content FROM archive WHERE role = 'user' AND conv BETWEEN 2 AND 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).where("role = 'user' AND conv BETWEEN 2 AND 40").select("conv", "idx", "role", "content").orderBy("conv", "idx")


@query("sc03_keys_lookup", "WITH <archive> SELECT a.conv, a.idx, a.rid FROM archive a WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.conv AND l.quality = 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("conv"))
    return archive(spark, d).join(keys, "conv", "left_semi").select("conv", "idx", "rid")


@query("sc04_insert_absent", "WITH <archive> SELECT conv, idx, rid, tokens FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d).select("conv", "idx", "rid", "tokens")
    return lifecycle.insert_absent(rows.where("idx < 2"), rows, ["conv", "idx"])


@query(
    "sc05_upsert",
    "WITH <ops> SELECT conv, path, op, event_id FROM (SELECT *, row_number() OVER (PARTITION BY conv, path ORDER BY event_id DESC) AS rk FROM ops) WHERE rk = 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = file_ops(spark, d).select("conv", "path", "op", "event_id")
    return lifecycle.upsert(rows.where("op <> 'bash'"), rows.where("op = 'bash'"), ["conv", "path"], "event_id")


@query("sc06_soft_delete", "WITH <archive> SELECT rid, tokens, CASE WHEN role = 'system' THEN true ELSE false END AS deleted, CASE WHEN role = 'system' THEN idx END AS deleted_at FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    gone = F.col("role") == "system"
    return archive(spark, d).select("rid", "tokens", gone.alias("deleted"), F.when(gone, F.col("idx")).alias("deleted_at"))


@query("sc07_journal_tail", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("sc09_read_or_empty", "WITH <archive> SELECT conv, count(*) AS n FROM archive GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    missing = read_or_empty(spark, f"{d}/no_such_table.parquet", PIECES)
    return archive(spark, d).unionByName(missing).groupBy("conv").agg(F.count("*").alias("n"))


@query(
    "sc12_message_parts",
    """SELECT conv_id AS conv, turn AS idx, part, body FROM (
         SELECT conv_id, turn, 'message' AS part, text AS body FROM conversations
         UNION ALL SELECT conv_id, turn, 'first_line', string_split(text, chr(10))[1] FROM conversations WHERE role = 'assistant'
         UNION ALL SELECT conv_id, turn, 'args', 'say {"n":' || length(text) || '}' FROM conversations WHERE role = 'assistant')""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    own = F.col("role") == "assistant"
    parts = F.array(
        F.struct(F.lit("message").alias("part"), F.col("text").alias("body")),
        F.when(own, F.struct(F.lit("first_line").alias("part"), F.get(F.split("text", "\n"), F.lit(0)).alias("body"))),
        F.when(own, F.struct(F.lit("args").alias("part"), F.concat(F.lit('say {"n":'), F.length("text"), F.lit("}")).alias("body"))),
    )
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").alias("idx"), F.explode(F.array_compact(parts)).alias("p")).select("conv", "idx", "p.part", "p.body")


@query(
    "sc13_export_history",
    "WITH <ops> SELECT conv, path, max(CASE WHEN op = 'write' THEN value END) AS written, max(CASE WHEN op = 'edit' THEN value END) AS edited FROM (SELECT conv, path, op, arg_max(value, idx) AS value FROM ops WHERE op IN ('write', 'edit') GROUP BY ALL) GROUP BY conv, path",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    last = lifecycle.latest_versions(file_ops(spark, d).where("op IN ('write', 'edit')"), ["conv", "path", "op"], "value", "idx")
    out = last.groupBy("conv", "path").pivot("op", ["write", "edit"]).agg(F.max("value"))
    return out.withColumnsRenamed({"write": "written", "edit": "edited"})


@query("sc14_history_markdown", "WITH <archive> SELECT conv, string_agg('## ' || role || chr(10) || content, chr(10) || chr(10) ORDER BY idx) AS markdown FROM archive GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct("idx", F.concat(F.lit("## "), "role", F.lit("\n"), "content").alias("entry"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"])
    return archive(spark, d).groupBy("conv").agg(F.array_join(entries, "\n\n").alias("markdown"))


@query(
    "sc15_evidence",
    r"""WITH <archive>, rules AS (SELECT * FROM (VALUES ('r1', 'th[a-z]+tion', 'user', 0, 3), ('r2', 'ing', 'assistant', 1, 9), ('r3', '\bder\b', 'user', 0, 99)) t(rule, pattern, wanted, lo, hi))
        SELECT rule, rid FROM archive JOIN rules ON role = wanted AND idx BETWEEN lo AND hi AND regexp_matches(content, pattern)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("r1", "th[a-z]+tion", "user", 0, 3), ("r2", "ing", "assistant", 1, 9), ("r3", r"\bder\b", "user", 0, 99)], "rule string, pattern string, wanted string, lo int, hi int")
    found = F.expr("role = wanted AND idx BETWEEN lo AND hi AND content RLIKE pattern")
    return archive(spark, d).join(F.broadcast(rules), found).select("rule", "rid")


@query(
    "sc17_turn_groups",
    """WITH <archive>, m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY idx) AS turn FROM archive)
       SELECT conv, turn, count(*) AS n, min(idx) AS first_idx, string_agg(role, '>' ORDER BY idx) AS roles FROM m GROUP BY conv, turn""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.islands(archive(spark, d), ["conv"], ["idx"], F.col("role") == "user")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("idx", "role"))), lambda x: x["role"])
    return rows.groupBy("conv", F.col("island").alias("turn")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.array_join(roles, ">").alias("roles"))


# Filters and predicates
@query("pf01_substring_search", "WITH <archive> SELECT conv, idx, rid FROM archive WHERE contains(lower(content), 'tion') ORDER BY idx DESC, conv LIMIT 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).where(F.contains(F.lower("content"), F.lit("tion"))).orderBy(F.desc("idx"), "conv").limit(40).select("conv", "idx", "rid")


@query("pf02_visible_pieces", "WITH <archive>, cur AS (SELECT rid FROM archive WHERE role = 'system') SELECT conv, idx, rid FROM archive WHERE idx < 3 AND role <> 'system' OR rid IN (SELECT rid FROM cur)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    seen = structure.visible(rows, rows.where("role = 'system'"), 3)
    return seen.where("role <> 'system' OR idx >= 0").select("conv", "idx", "rid")


@query("pf03_role_filter", "WITH <archive> SELECT conv, idx FROM archive WHERE role IN ('assistant', 'system')")
def _(spark: SparkSession, d: str) -> DataFrame:
    alias = {"reply": "assistant", "rules": "system"}
    return archive(spark, d).where(F.col("role").isin([alias.get(x, x) for x in "reply|rules".split("|")])).select("conv", "idx")


@query(
    "pf04_segment_filter",
    """WITH <archive>, cuts AS (SELECT conv, idx AS cut_idx FROM archive WHERE role = 'user' AND idx > 0),
       s AS (SELECT a.conv, a.idx, (SELECT count(*) FROM cuts c WHERE c.conv = a.conv AND c.cut_idx <= a.idx) AS seg FROM archive a) SELECT * FROM s WHERE seg = 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    cuts = rows.where("role = 'user' AND idx > 0").select("conv", F.col("idx").alias("cut_idx"))
    return structure.segment_of(rows, cuts, ["conv"]).where("seg = 2").select("conv", "idx", "seg")


@query("pf05_suffix_path", "SELECT page_id, url FROM pages WHERE url = '/' OR ends_with(url, '/') OR ends_with('/', url)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").where(X.path_matches(F.col("url"), F.lit("/"))).select("page_id", "url")


@query("pf06_human_user", r"WITH <archive> SELECT conv, idx FROM archive WHERE role = 'user' AND NOT (trim(content) LIKE '<tool_response>%' AND trim(content) LIKE '%</tool_response>')")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim("content")
    wrapped = t.startswith("<tool_response>") & t.endswith("</tool_response>")
    return archive(spark, d).where((F.col("role") == "user") & ~wrapped).select("conv", "idx")


@query("pf07_recognisers", r"SELECT doc_id, regexp_matches(text, '(?m)^Licensed') AS licence, starts_with(text, 'The') AS starts, regexp_matches(text, '\bError\b|Traceback') AS trouble FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", t.rlike("(?m)^Licensed").alias("licence"), t.startswith("The").alias("starts"), t.rlike(r"\bError\b|Traceback").alias("trouble"))


@query(
    "pf08_content_parts",
    "SELECT conv_id, array_to_string(list_transform(list_filter(p, lambda x: x.k = 'text'), lambda x: x.v), chr(10)) AS body, len(list_filter(p, lambda x: x.k = 'image')) AS n_images FROM (SELECT conv_id, list({'k': CASE WHEN role = 'system' THEN 'image' ELSE 'text' END, 'v': left(text, 20)} ORDER BY turn) AS p FROM conversations GROUP BY conv_id)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    part = F.struct("turn", F.when(F.col("role") == "system", "image").otherwise("text").alias("k"), F.substring("text", 1, 20).alias("v"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    kept = F.transform(F.filter("p", lambda x: x["k"] == "text"), lambda x: x["v"])
    return rows.select("conv_id", F.array_join(kept, "\n").alias("body"), F.size(F.filter("p", lambda x: x["k"] == "image")).alias("n_images"))


@query("pf09_quote_frames", "SELECT conv_id, turn, '[quoted CONTEXT SUMMARY] ' || text || ' [quoted /PRIOR CONTEXT]' AS quoted FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    framed = F.concat(F.lit("[CONTEXT SUMMARY] "), "text", F.lit(" [/PRIOR CONTEXT]"))
    return read(spark, d, "conversations").select("conv_id", "turn", X.quote_frames(X.quote_frames(framed)).alias("quoted"))


@query("pf10_pins", "SELECT conv_id, turn, trim(l) AS pin FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE trim(l) <> '' UNION ALL SELECT conv_id, turn, 'kept' FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("[[importante]] kept [[/importante]]\n"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("!! "), x)), "\n"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(X.pinned(marked)).alias("pin"))


@query("pf11_disposable", "SELECT conv_id, turn, turn % 2 = 0 AS drop_it FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("turn") % 2 == 0, F.lit("~ ")).otherwise(F.lit("~~ "))
    return read(spark, d, "conversations").select("conv_id", "turn", X.disposable(F.concat(F.lit("x\n"), sign, F.col("text"))).alias("drop_it"))


@query("pf13_hidden_set", "WITH <archive> SELECT conv, idx FROM archive WHERE tokens > 100 UNION SELECT conv, idx FROM archive WHERE idx BETWEEN 1 AND 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    return rows.where("tokens > 100").select("conv", "idx").union(rows.where("idx BETWEEN 1 AND 2").select("conv", "idx")).distinct()


@query("pf14_fold_blobs", r"SELECT page_id, length(regexp_replace(html, '<script>[^<]*', '<blob>', 'g')) AS n FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<script>[^<]*", "<blob>")).alias("n"))


@query("pf15_leak_check", "SELECT event_id, key FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('n', 'name')")
def _(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("n",), ("name",)], "key string")
    keys = read(spark, d, "events").select("event_id", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return keys.join(F.broadcast(allowed), "key", "left_anti").select("event_id", "key")


@query("pf16_journal_filter", "SELECT event_id, user_id, ts FROM events WHERE event_type IN ('error', 'signup') AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 30")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").where("event_type IN ('error', 'signup') AND user_id = 7")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "user_id", "ts")


@query("pf17_marker_bytes", "SELECT page_id, len(regexp_extract_all(html, '</p>')) * 4 AS slack FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", (F.regexp_count("html", F.lit("</p>")) * F.octet_length(F.lit("</p>"))).alias("slack"))


# Joins
@query("jn03_not_indexed", "WITH <archive> SELECT conv, idx FROM archive WHERE idx % 2 = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, index = archive(spark, d), SearchIndex(spark, folder(spark, "search-index"))
    index.ensure(rows.where("idx % 2 = 0"))
    return index.not_indexed(rows).select("conv", "idx")


@query("jn05_first_user_message", "WITH <archive> SELECT conv, arg_min(content, idx) AS first_text FROM archive WHERE role = 'user' GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return structure.first_message(archive(spark, d), ["conv"], "user")


@query(
    "jn06_last_call",
    "WITH <ops>, c AS (SELECT conv, path, max(idx) AS call_idx FROM ops WHERE op = 'write' GROUP BY conv, path) SELECT o.conv, o.path, o.idx, c.call_idx FROM ops o JOIN c USING (conv, path) WHERE o.op = 'read' AND c.call_idx < o.idx",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ops = file_ops(spark, d).select("conv", "path", "idx", "op")
    out = structure.last_call_wins(ops.where("op = 'write'"), ops.where("op = 'read'"), ["conv", "path"])
    return out.select("conv", "path", "idx", F.col("call.idx").alias("call_idx"))


@query(
    "jn07_positional_links",
    """WITH <ops>, o AS (SELECT conv, idx, op, last_value(CASE WHEN op = 'write' THEN idx END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY idx) AS opened_by FROM ops)
       SELECT conv, idx, opened_by, row_number() OVER (PARTITION BY conv, opened_by ORDER BY idx) AS k FROM o WHERE op = 'bash' AND opened_by IS NOT NULL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return structure.nth_after(file_ops(spark, d), ["conv"], F.col("op") == "write", F.col("op") == "bash").select("conv", "idx", "opened_by", "k")


@query("jn08_segment_of_message", "WITH <archive>, c AS (SELECT conv, idx AS cut_idx FROM archive WHERE role = 'user' AND idx > 0) SELECT a.conv, a.idx, count(c.cut_idx) AS seg FROM archive a LEFT JOIN c ON c.conv = a.conv AND c.cut_idx <= a.idx GROUP BY a.conv, a.idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    cuts = rows.where("role = 'user' AND idx > 0").select("conv", F.col("idx").alias("cut_idx"))
    return structure.segment_of(rows, cuts, ["conv"]).select("conv", "idx", "seg")


@query("jn09_last_known_prefix", "WITH <archive> SELECT content, arg_max(conv, conv) AS conv, max(conv) AS latest FROM archive GROUP BY content HAVING count(*) >= 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).groupBy("content").agg(F.max_by("conv", "conv").alias("conv"), F.max("conv").alias("latest"))


@query("jn13_neighbors", "WITH <archive> SELECT a.conv, a.idx, b.idx AS of_idx FROM archive a JOIN archive b ON a.conv = b.conv AND b.role = 'system' AND a.idx BETWEEN b.idx - 2 AND b.idx + 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    return structure.neighbors(rows, rows.where("role = 'system'").select("conv", "idx"), 2, ["conv"]).select("conv", "idx", "of_idx")


@query("jn14_turn_of_op", "WITH <ops> SELECT conv, idx, last_value(CASE WHEN op = 'write' THEN idx END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY idx) AS turn_idx FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    return structure.turn_of(file_ops(spark, d), ["conv"], F.col("op") == "write").select("conv", "idx", "turn_idx")


@query("jn15_prefix_join", "WITH b AS (SELECT item_id, left(text, 30) AS p FROM benchmark) SELECT b.item_id, count(*) AS n FROM b JOIN benchmark t ON left(t.text, 30) = p GROUP BY b.item_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "benchmark").select("item_id", F.substring("text", 1, 30).alias("p"))
    return rows.join(rows.groupBy("p").agg(F.count("*").alias("n")), "p").select("item_id", "n")


@query("jn16_missing_blocks", "SELECT sha256(text) AS hash FROM documents EXCEPT SELECT sha256(text) FROM documents WHERE lang = 'en'")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "lang")
    return lifecycle.garbage(rows.select("hash").distinct(), rows.where("lang = 'en'"))


# Aggregations
@query("ag01_conversation_stats", "WITH <archive> SELECT conv, count(*) AS n, sum(tokens)::BIGINT AS tokens, count(*) FILTER (role = 'assistant') AS replies, coalesce(sum(tokens) FILTER (role = 'assistant'), 0)::BIGINT AS reply_tokens FROM archive GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("role") == "assistant"
    return archive(spark, d).groupBy("conv").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_if(own).alias("replies"), F.coalesce(F.sum(F.when(own, F.col("tokens"))), F.lit(0)).alias("reply_tokens"))


@query("ag02_conversation_inventory", "WITH <archive> SELECT conv, count(*) AS n, sum(tokens)::BIGINT AS tokens, min(idx) AS first_idx, max(idx) AS last_idx, left(arg_min(content, idx) FILTER (role = 'user'), 60) AS first_text FROM archive GROUP BY conv")
def _(spark: SparkSession, d: str) -> DataFrame:
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("idx")))
    return archive(spark, d).groupBy("conv").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.substring(first, 1, 60).alias("first_text"))


@query("ag03_latest_conversation", "SELECT user_id AS conv, max(ts) AS latest FROM events GROUP BY user_id ORDER BY latest DESC, conv LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("user_id").alias("conv")).agg(F.max("ts").alias("latest")).orderBy(F.desc("latest"), "conv").limit(1)


@query(
    "ag04_inventory",
    "WITH <archive> SELECT 'archive' AS table_name, conv, count(*) AS n_rows, sum(strlen(role) + strlen(content))::BIGINT AS n_bytes FROM archive GROUP BY conv UNION ALL SELECT 'events', user_id, count(*), sum(strlen(event_type))::BIGINT FROM events GROUP BY user_id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    tables = {"archive": archive(spark, d).select("conv", "role", "content"), "events": read(spark, d, "events").select(F.col("user_id").alias("conv"), "event_type"), "labels": read(spark, d, "labels")}
    own = F.length(F.col("conv").cast("string"))
    sized = lifecycle.inventory({k: v.withColumn("_own", own) if "conv" in v.columns else v for k, v in tables.items()})
    # the key's own bytes and the helper's are not counted
    digits = F.length(F.col("conv").cast("string"))
    return sized.withColumn("n_bytes", F.col("n_bytes") - F.col("n_rows") * (digits + F.length(digits.cast("string"))))


@query("ag05_all_conversations", "SELECT conv_id AS conv FROM conversations UNION SELECT user_id FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("conv")).union(read(spark, d, "events").select("user_id")).distinct()


@query("ag06_top_files", "WITH <ops> SELECT path, count(*) AS n FROM ops WHERE op IN ('write', 'edit') GROUP BY path ORDER BY n DESC, path LIMIT 6")
def _(spark: SparkSession, d: str) -> DataFrame:
    return file_ops(spark, d).where("op IN ('write', 'edit')").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(6)


@query("ag07_saved_over_keys", "WITH <archive> SELECT count(*) AS n, sum(tokens)::BIGINT AS saved FROM archive WHERE rid IN (SELECT rid FROM archive WHERE idx > 2)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    return rows.join(rows.where("idx > 2").select("rid"), "rid", "left_semi").agg(F.count("*").alias("n"), F.sum("tokens").alias("saved"))


@query(
    "ag08_common_terms",
    "WITH <archive>, t AS (SELECT DISTINCT rid, unnest(regexp_extract_all(translate(lower(content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')) AS term FROM archive) SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) > 0.4 * (SELECT count(DISTINCT rid) FROM archive) AND (SELECT count(DISTINCT rid) FROM archive) >= 8".replace("\\\\", "\\"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    n = rows.agg(F.count_distinct("rid").alias("n"))
    counts = rows.select("rid", F.explode(F.array_distinct(X.terms(F.col("content")))).alias("term")).groupBy("term").agg(F.count_distinct("rid").alias("df"))
    return counts.crossJoin(F.broadcast(n)).where("n >= 8 AND df > 0.4 * n").select("term", "df")  # n is one row


@query("ag12_turn_rollup", "WITH <ops>, t AS (SELECT *, count(*) FILTER (op = 'write') OVER (PARTITION BY conv ORDER BY idx) AS turn FROM ops) SELECT conv, turn, count(DISTINCT path) AS files, count(*) AS n_ops, count(*) FILTER (op = 'bash') AS commands, count(*) FILTER (failed) AS failures, array_to_string(list_sort(list(DISTINCT path) FILTER (failed))[1:2], ',') AS first_failed FROM t GROUP BY conv, turn")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.islands(file_ops(spark, d), ["conv"], ["idx"], F.col("op") == "write").withColumnRenamed("island", "turn")
    failed = F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("path"))))
    first = F.when(F.size(failed) > 0, F.array_join(F.slice(failed, 1, 2), ","))
    return rows.groupBy("conv", "turn").agg(F.count_distinct("path").alias("files"), F.count("*").alias("n_ops"), F.count_if(F.col("op") == "bash").alias("commands"), F.count_if("failed").alias("failures"), first.alias("first_failed"))


@query("ag13_receipts", "WITH <ops>, r AS (SELECT conv, list(op || ' ' || path ORDER BY idx) AS all_ops FROM ops GROUP BY conv) SELECT conv, CASE WHEN len(all_ops) <= 8 THEN array_to_string(all_ops, '; ') ELSE array_to_string(all_ops[1:7], '; ') || '; ' || (len(all_ops) - 7) || ' more' END AS receipt FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    entries = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(" ", "op", "path").alias("r")))), lambda x: x["r"])
    rows = file_ops(spark, d).groupBy("conv").agg(entries.alias("r"))
    short = F.concat(F.array_join(F.slice("r", 1, 7), "; "), F.lit("; "), F.size("r") - 7, F.lit(" more"))
    return rows.select("conv", F.when(F.size("r") <= 8, F.array_join("r", "; ")).otherwise(short).alias("receipt"))


@query("ag14_filter_impact", "SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, count(*) FILTER (value > 50) AS high, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = read(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("kind"), "n", "high", "total")


@query("ag16_reread_summary", "WITH <archive>, s AS (SELECT conv, sum(tokens)::BIGINT AS total, max(tokens) AS largest FROM archive GROUP BY conv) SELECT max(total) AS most, sum(total)::BIGINT AS tokens, count(*) FILTER (total > 500) AS over_window, max(largest) AS largest FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    per = archive(spark, d).groupBy("conv").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("largest"))
    return per.agg(F.max("total").alias("most"), F.sum("total").alias("tokens"), F.count_if(F.col("total") > 500).alias("over_window"), F.max("largest").alias("largest"))


@query("ag17_estimator_error", "SELECT lang, round(avg(length(text) / 3.5 / len(regexp_extract_all(text, '[^ \\n]+'))), 6) AS mean_ratio, round(max(length(text) / 3.5 / len(regexp_extract_all(text, '[^ \\n]+'))), 6) AS max_ratio FROM documents WHERE len(regexp_extract_all(text, '[^ \\n]+')) > 0 GROUP BY lang")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"[^ \n]+"))
    ratio = F.length("text") / 3.5 / F.col("n")
    return read(spark, d, "documents").withColumn("n", n).where("n > 0").groupBy("lang").agg(F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.max(ratio), 6).alias("max_ratio"))


@query("ag18_latest_ratio", "SELECT event_type, round(arg_max(value, event_id) * 1.1, 6) AS margin FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.max_by("value", "event_id") * 1.1, 6).alias("margin"))


@query("ag20_catalogue", "WITH w AS (SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages), c AS (SELECT split_part(host, '.', 1) AS category, count(*) AS n FROM w GROUP BY 1) SELECT CASE WHEN n > 1 THEN category ELSE 'other' END AS category, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    hosts = read(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).distinct()
    counts = hosts.groupBy(F.split_part("host", F.lit("."), F.lit(1)).alias("category")).agg(F.count("*").alias("n"))
    return counts.groupBy(F.when(F.col("n") > 1, F.col("category")).otherwise("other").alias("category")).agg(F.sum("n").alias("n"))


@query("ag22_request_series", "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'view' GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'view'").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Windows
@query("wn01_age_in_turns", "WITH <archive> SELECT conv, idx, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS age FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.age_in_turns(archive(spark, d), ["conv"], ["idx"]).select("conv", "idx", "age")


@query("wn02_protected_tail", "WITH <archive> SELECT conv, idx, coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 200 AS protected FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.protected_tail(archive(spark, d), ["conv"], [F.col("idx").desc()], 200).select("conv", "idx", "protected")


@query("wn03_prefix_offsets", "WITH <archive> SELECT conv, idx, (40 + coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.prefix_offsets(archive(spark, d), ["conv"], ["idx"], start=40).select("conv", "idx", "offset")


@query("wn04_suffix_totals", "WITH <archive> SELECT conv, idx, sum(tokens) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS tail FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return budget.suffix_totals(archive(spark, d), ["conv"], ["idx"]).select("conv", "idx", "tail")


@query("wn05_rereads", "WITH <ops>, l AS (SELECT conv, path, idx, op, lag(idx) OVER w AS prev_idx, lag(op) OVER w AS prev_op FROM ops WINDOW w AS (PARTITION BY conv, path ORDER BY idx)) SELECT conv, path, idx, idx - prev_idx AS gap, prev_op FROM l WHERE op = 'read' AND prev_idx IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return structure.rereads(file_ops(spark, d)).select("conv", "path", "idx", "gap", "prev_op")


@query("wn06_first_write", "WITH <ops> SELECT conv, path, idx, op, idx = min(CASE WHEN op = 'write' THEN idx END) OVER (PARTITION BY conv, path) AS first_write FROM ops")
def _(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.when(F.col("op") == "write", F.col("idx"))).over(Window.partitionBy("conv", "path"))
    return file_ops(spark, d).select("conv", "path", "idx", "op", (F.col("idx") == first).alias("first_write"))


@query("wn07_exchange_end", "WITH <archive> SELECT conv, idx, min(CASE WHEN role = 'user' THEN idx END) OVER (PARTITION BY conv ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    later = F.min(F.when(F.col("role") == "user", F.col("idx"))).over(Window.partitionBy("conv").orderBy("idx").rowsBetween(1, Window.unboundedFollowing))
    return archive(spark, d).select("conv", "idx", later.alias("next_user"))


@query(
    "wn08_first_difference",
    """WITH <archive>, p AS (SELECT a.conv, a.idx, a.tokens, a.role IS DISTINCT FROM b.role AS differs FROM archive a LEFT JOIN archive b ON b.conv = a.conv + 1 AND b.idx = a.idx),
       f AS (SELECT conv, min(idx) FILTER (differs) AS first_diff FROM p GROUP BY conv) SELECT p.conv, first_diff, coalesce(sum(tokens) FILTER (p.idx >= first_diff), 0)::BIGINT AS lost FROM p JOIN f USING (conv) GROUP BY p.conv, first_diff""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d).select("conv", "idx", "tokens", "role")
    other = rows.select((F.col("conv") - 1).alias("conv"), "idx", F.col("role").alias("other_role"))
    both = rows.join(other, ["conv", "idx"], "left").withColumn("first_diff", F.min(F.when(~F.col("role").eqNullSafe(F.col("other_role")), F.col("idx"))).over(Window.partitionBy("conv")))
    return both.groupBy("conv", "first_diff").agg(F.coalesce(F.sum(F.when(F.col("idx") >= F.col("first_diff"), F.col("tokens"))), F.lit(0)).alias("lost"))


@query("wn10_latest_version_total", "WITH l AS (SELECT event_id, user_id, value - coalesce(lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id), 0) AS change FROM events) SELECT event_id, user_id, round(sum(change) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM l")
def _(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = read(spark, d, "events").withColumn("change", F.col("value") - F.coalesce(before, F.lit(0)))
    return rows.select("event_id", "user_id", F.round(F.sum("change").over(Window.partitionBy("user_id").orderBy("event_id")), 4).alias("total"))


@query("wn12_newest_per_key", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("at", F.row_number().over(w)).where("at = 1").select("user_id", "event_type", "event_id")


@query("wn14_repeated_lines", "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(X.full_lines(F.col("text"))).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "wn15_gaps_between_kept_lines",
    "WITH l AS (SELECT doc_id, u.line, u.pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u), k AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l WHERE length(line) > 120) SELECT doc_id, pos, pos - prev > 1 AS gap FROM k",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("p", "line")).where(F.length("line") > 120).withColumn("pos", F.col("p") + 1)
    return rows.select("doc_id", "pos", (F.col("pos") - F.lag("pos").over(Window.partitionBy("doc_id").orderBy("pos")) > 1).alias("gap"))


@query(
    "wn16_line_offsets",
    "WITH l AS (SELECT doc_id, u.line, u.pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u) SELECT doc_id, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts FROM l",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("pos"), (F.length("line") + 1).alias("n"))
    return budget.prefix_offsets(rows, ["doc_id"], ["pos"], "n").select("doc_id", "pos", F.col("offset").alias("starts"))


# Top-k
@query("tk05_role_order", "WITH <archive> SELECT conv, idx, row_number() OVER (PARTITION BY conv ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, idx) AS at FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return archive(spark, d).select("conv", "idx", F.row_number().over(Window.partitionBy("conv").orderBy(band, "idx")).alias("at"))


@query("tk07_largest_first", "WITH <archive> SELECT conv, idx, tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY tokens DESC, idx) AS rk FROM archive) WHERE rk <= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv").orderBy(F.desc("tokens"), "idx")
    return archive(spark, d).withColumn("at", F.row_number().over(w)).where("at <= 2").select("conv", "idx", "tokens")


@query("tk08_removal_order", "WITH <archive> SELECT conv, idx, row_number() OVER (PARTITION BY conv ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, 1000.0 / (tokens + 1), idx) AS at FROM archive")
def _(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    return archive(spark, d).select("conv", "idx", F.row_number().over(Window.partitionBy("conv").orderBy(band, 1000.0 / (F.col("tokens") + 1), "idx")).alias("at"))


@query("tk09_prefix_hit", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM conversations), q AS (SELECT * FROM (VALUES ('th'), ('ver'), ('onl')) v(word)) SELECT word, arg_min(tok, length(tok)::BIGINT * 100000 + rank) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tok) AS rank FROM q JOIN t ON starts_with(tok, word)) GROUP BY word")
def _(spark: SparkSession, d: str) -> DataFrame:
    toks = read(spark, d, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("tok"))
    wanted = F.explode(F.filter(F.array(F.lit("th"), F.lit("ver"), F.lit("onl")), lambda w: F.col("tok").startswith(w))).alias("word")
    return toks.select("tok", wanted).groupBy("word").agg(F.min_by("tok", F.struct(F.length("tok"), "tok")).alias("hit"))


# Sets and dedup
@query("st02_content_dedup", "SELECT sha1(trim(text)) AS hash, min(doc_id) AS \"first\", count(*) AS n FROM documents GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.content_dedup(read(spark, d, "documents"), "doc_id", "text")


@query("st03_superset", "WITH q AS (SELECT ['the', 'and', 'of'] AS wanted) SELECT doc_id FROM documents, q WHERE list_has_all(regexp_extract_all(lower(text), '[a-z]+'), wanted)")
def _(spark: SparkSession, d: str) -> DataFrame:
    have = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read(spark, d, "documents").where(F.size(F.array_except(F.array(F.lit("the"), F.lit("and"), F.lit("of")), have)) == 0).select("doc_id")


@query("st04_new_identifiers", r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z]+[0-9]+'))) AS n_identifiers FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+[0-9]+"), F.lit(0)))).alias("n_identifiers"))


@query(
    "st05_covered_spans",
    """WITH <ops>, s AS (SELECT conv, idx, op, idx * 3 AS a, idx * 3 + CASE WHEN op = 'write' THEN 7 ELSE 2 END AS b FROM ops), w AS (SELECT conv, a, b, max(b) OVER (PARTITION BY conv ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE op = 'write'),
       i AS (SELECT *, sum(CASE WHEN a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY a, b) AS g FROM w), m AS (SELECT conv, min(a) AS a, max(b) AS b FROM i GROUP BY conv, g)
       SELECT s.conv, s.idx FROM s WHERE s.op = 'read' AND EXISTS (SELECT 1 FROM m WHERE m.conv = s.conv AND m.a <= s.a AND s.b <= m.b)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    spans = file_ops(spark, d).select("conv", "idx", "op", (F.col("idx") * 3).alias("a"), (F.col("idx") * 3 + F.when(F.col("op") == "write", 7).otherwise(2)).alias("b"))
    return structure.covered(spans.where("op = 'read'"), spans.where("op = 'write'"), ["conv"]).select("conv", "idx")


@query("st07_garbage", "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1'))")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "source")
    return lifecycle.garbage(rows.select("hash").distinct(), rows.where("source IN ('src0', 'src1')"))


@query("st08_forget_plan", "SELECT 'conversations' AS table_name, count(*) AS n FROM conversations WHERE conv_id = 5 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id = 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    plan = {"conversations": read(spark, d, "conversations").where("conv_id = 5"), "events": read(spark, d, "events").where("user_id = 5")}
    out = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in plan.items()]
    return out[0].unionByName(out[1])


@query("fg01_forget", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    tables = lifecycle.delete_conversation({"conversations": read(spark, d, "conversations"), "labels": read(spark, d, "labels")}, F.lit(1), "conv_id")
    return tables["conversations"].select("conv_id", "turn")


# Blocks
@query("kv01_fixed_blocks", "SELECT doc_id, CAST(i - 1 AS INT) AS pos, length(substr(text, (i - 1) * 1000 + 1, 1000)) AS n, sha256(substr(text, (i - 1) * 1000 + 1, 1000)) AS hash FROM documents, LATERAL (SELECT unnest(range(1, CAST(ceil(length(text) / 1000.0) AS BIGINT) + 1)) AS i) WHERE length(text) > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.fixed_blocks(read(spark, d, "documents"), "doc_id", "text", 1000)


@query("ag09_refcounts", "WITH b AS (SELECT sha256(substr(text, (i - 1) * 1000 + 1, 1000)) AS hash, length(substr(text, (i - 1) * 1000 + 1, 1000)) AS n FROM documents, LATERAL (SELECT unnest(range(1, CAST(ceil(length(text) / 1000.0) AS BIGINT) + 1)) AS i) WHERE length(text) > 0) SELECT hash, count(*) AS refs, max(n) AS n FROM b GROUP BY hash")
def _(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.refcounts(lifecycle.fixed_blocks(read(spark, d, "documents"), "doc_id", "text", 1000))


@query("ag10_usage", "WITH b AS (SELECT doc_id, sha256(substr(text, (i - 1) * 1000 + 1, 1000)) AS hash, length(substr(text, (i - 1) * 1000 + 1, 1000)) AS n FROM documents, LATERAL (SELECT unnest(range(1, CAST(ceil(length(text) / 1000.0) AS BIGINT) + 1)) AS i) WHERE length(text) > 0), u AS (SELECT hash, count(*) AS refs, max(n) AS n FROM b GROUP BY hash) SELECT count(*) AS blocks, sum(n)::BIGINT AS stored, sum(n * refs)::BIGINT AS logical, round(sum(n * refs) / sum(n), 6) AS ratio FROM u")
def _(spark: SparkSession, d: str) -> DataFrame:
    used = lifecycle.refcounts(lifecycle.fixed_blocks(read(spark, d, "documents"), "doc_id", "text", 1000))
    logical = F.sum(F.col("n") * F.col("refs"))
    return used.agg(F.count("*").alias("blocks"), F.sum("n").alias("stored"), logical.alias("logical"), F.round(F.try_divide(logical, F.sum("n")), 6).alias("ratio"))


@query("ag11_dedup_by_kind", "WITH b AS (SELECT lang, doc_id, i, sha256(substr(text, (i - 1) * 1000 + 1, 1000)) AS hash, length(substr(text, (i - 1) * 1000 + 1, 1000)) AS n FROM documents, LATERAL (SELECT unnest(range(1, CAST(ceil(length(text) / 1000.0) AS BIGINT) + 1)) AS i) WHERE length(text) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, i) AS rk FROM b) SELECT lang, sum(n)::BIGINT AS raw, sum(CASE WHEN rk = 1 THEN n ELSE 0 END)::BIGINT AS new_raw FROM r GROUP BY lang")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("key", F.struct("lang", "doc_id"))
    blocks = lifecycle.fixed_blocks(docs, "key", "text", 1000).select("key.lang", "key.doc_id", "pos", "n", "hash")
    firsts = blocks.groupBy("hash").agg(F.min_by(F.struct("lang", "n"), F.struct("doc_id", "pos")).alias("f")).groupBy("f.lang").agg(F.sum("f.n").alias("new_raw"))
    return blocks.groupBy("lang").agg(F.sum("n").alias("raw")).join(firsts, "lang", "left").select("lang", "raw", F.coalesce("new_raw", F.lit(0)).alias("new_raw"))


@query("rm01_probes", "WITH <archive> SELECT DISTINCT conv FROM archive WHERE role = 'system'")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    return rows.select("conv").distinct().join(rows.where("role = 'system'").select("conv"), "conv", "left_semi")


@query("rm05_recently_used", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY greatest(event_id, coalesce(CASE WHEN event_type = 'view' THEN event_id + 500 END, 0)) DESC, event_id DESC) AS rk FROM events) WHERE rk <= 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    used = F.greatest("event_id", F.coalesce(F.when(F.col("event_type") == "view", F.col("event_id") + 500), F.lit(0)))
    return read(spark, d, "events").orderBy(used.desc(), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("rm09_changes_of_kind", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("event_id", "user_id", "event_type")


@query("rc14_read_only_archive", "SELECT source AS conv, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS idx, doc_id FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return document_archive(spark, d).select("conv", "idx", "doc_id")
