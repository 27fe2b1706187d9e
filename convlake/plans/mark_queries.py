"""Users' marks and test reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.operators import marks, reports
from convlake.plans.registry import query
from convlake.sources.archive import archive, read

_MARKED = """<archive>, m AS (SELECT conv, idx, role, content, string_split(content, chr(10))[1] AS top FROM archive),
  p AS (SELECT conv, idx, trim(left(top, 80)) AS pin, idx % 3 <> 0 AS active FROM m WHERE role = 'user' AND conv % 3 <> 0 AND trim(left(top, 80)) <> ''), x AS (SELECT conv, idx FROM m WHERE role = 'user' AND (conv + idx) % 4 = 0)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """The archive with its first lines pinned in two conversations of three, thrown away in some, and signs that are no marks in others."""
    top = F.substring(F.get(F.split("content", "\n", -1), F.lit(0)), 1, 80)
    pin = F.when(F.col("conv") % 3 == 0, F.concat(F.lit("see !! "), top)).otherwise(F.concat(F.lit("!! "), top))
    drop = F.when((F.col("conv") + F.col("idx")) % 4 == 0, F.lit("~ not needed")).otherwise(F.lit("~~ kept ~~"))
    return archive(spark, d).withColumn("content", F.concat_ws("\n", pin, drop, F.regexp_replace("content", "(?m)^[ \\t]*(!!|~)", ".")))


@query("rm08_scanned_marks", f"WITH {_MARKED} SELECT conv, idx, 'pin' AS kind, pin AS text FROM p WHERE conv % 2 = 1 UNION ALL SELECT conv, idx, 'drop', NULL FROM x WHERE idx <> 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Marks that are new where all of every second conversation's pins, and the drops of the third messages, are held."""
    rows = _marked(spark, d)
    nothing = rows.where("false")
    held = marks.scan_marks(rows.where("conv % 2 = 0"), nothing.select("conv", "idx", F.col("content").alias("text")), nothing)[0]
    pins, drops = marks.scan_marks(rows, held, rows.where("idx = 2").select("conv", "idx"))
    return pins.select("conv", "idx", F.lit("pin").alias("kind"), "text").unionByName(drops.select("conv", "idx", F.lit("drop").alias("kind"), F.lit(None).cast("string").alias("text")))


@query(
    "rc13_marks_view",
    f"""WITH {_MARKED}, t AS (SELECT conv, count(*) AS n_pins, count(*) FILTER (active) AS n_active, sum(CASE WHEN active THEN floor(length(pin) / 3.5 + 0.5) ELSE 0 END)::BIGINT AS pin_tokens FROM p GROUP BY conv),
       e AS (SELECT a.conv, max(u.idx) AS user_idx FROM m a JOIN m u ON u.conv = a.conv AND u.role = 'user' AND u.idx <= a.idx WHERE a.idx % 2 = 1 AND (a.conv + a.idx) % 6 = 0 GROUP BY a.conv, a.idx),
       n AS (SELECT conv, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS drops FROM (SELECT conv, idx FROM x UNION SELECT conv, user_idx FROM e) GROUP BY conv)
    SELECT conv, coalesce(n_pins, 0) AS n_pins, coalesce(n_active, 0) AS n_active, coalesce(pin_tokens, 0) AS pin_tokens, coalesce(pin_tokens, 0) > 40 AS over_limit, coalesce(drops, '') AS drops,
           (SELECT count(*) FROM m u WHERE u.conv = c.conv AND u.role = 'user') AS n_users FROM (SELECT DISTINCT conv FROM m) c LEFT JOIN t USING (conv) LEFT JOIN n USING (conv)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every third message's pins are switched off, and some answers are thrown away with their exchanges."""
    rows = _marked(spark, d)
    nothing = rows.where("false")
    found, drops = marks.scan_marks(rows, nothing.select("conv", "idx", F.col("content").alias("text")), nothing)
    pins = found.select("conv", F.col("idx").alias("id"), "idx", "text", F.lit(True).alias("active"))
    off = rows.where("idx % 3 = 0").select("conv", F.col("idx").alias("id"), F.lit(1).alias("seq"), F.lit("unpin").alias("action"), F.lit(None).cast("string").alias("text"))
    thrown = marks.exchanges(rows, rows.where("idx % 2 = 1 AND (conv + idx) % 6 = 0")).select("conv", F.col("user_idx").alias("idx"))
    view = marks.marks_view(rows, marks.apply_actions(pins, off), drops.unionByName(thrown), 40)
    shown = F.array_join(F.transform("drops", lambda x: x["idx"].cast("string")), ",")
    active = F.size(F.filter("pins", lambda x: x["active"]))
    return view.select("conv", F.size("pins").alias("n_pins"), active.alias("n_active"), "pin_tokens", "over_limit", shown.alias("drops"), F.size("users").alias("n_users"))


@query(
    "lf10_test_reports",
    """WITH l AS (SELECT user_id, event_type, 'tests/test_' || json_extract_string(props, '$.k') || '.py::test_' || event_id AS test, event_id, (row_number() OVER w - 1)::INT AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
         g AS (SELECT *, max(CASE WHEN event_type IN ('error', 'signup') THEN pos END) OVER w AS last, arg_max(event_type, pos) FILTER (event_type IN ('error', 'signup')) OVER w AS opened, count(*) FILTER (event_type IN ('view', 'purchase')) OVER (PARTITION BY user_id) AS results FROM l WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
         u AS (SELECT user_id, CASE WHEN opened = 'error' THEN last ELSE pos END AS a, max(pos) + 1 AS b, arg_min(event_type, pos) AS first_type, arg_min(test, pos) AS test, arg_min(event_id, pos) AS event_id FROM g
               WHERE results >= 3 AND (opened = 'error' OR event_type <> 'click' OR event_id % 2 = 0) GROUP BY ALL)
       SELECT user_id, a, b, CASE WHEN first_type = 'error' THEN 'block' ELSE 'line' END AS kind, CASE first_type WHEN 'view' THEN 'PASSED' WHEN 'purchase' THEN 'FAILED' WHEN 'error' THEN 'FAILED' END AS outcome,
              CASE WHEN first_type = 'error' THEN 'test_' || event_id WHEN first_type IN ('view', 'purchase') THEN test END AS test
       FROM u QUALIFY count(*) OVER (PARTITION BY user_id) >= 2""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a report: views pass, purchases fail, errors head a block that a signup ends, clicks are blank or notes."""
    kind, event = F.col("event_type"), F.col("event_id").cast("string")
    test = F.concat(F.lit("tests/test_"), F.get_json_object("props", "$.k"), F.lit(".py::test_"), event)
    line = F.when(kind == "view", F.concat(test, F.lit(" PASSED [ 10%]"))).when(kind == "purchase", F.concat(F.lit("FAILED "), test, F.lit(" - AssertionError")))
    line = line.when(kind == "error", F.concat(F.lit("_____ test_"), event, F.lit(" _____"))).when(kind == "signup", F.lit("===== summary =====")).otherwise(F.when(F.col("event_id") % 2 == 0, F.lit("E   note")).otherwise(F.lit("  ")))
    texts = read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return reports.report_units(texts, "user_id", "body")
