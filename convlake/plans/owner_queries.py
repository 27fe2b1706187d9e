"""Owners of engines' states, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.plans.registry import query
from convlake.sources import scratch
from convlake.sources.archive import read
from convlake.streaming import journal, owners


@query(
    "ss05_owner_states",
    """WITH r AS (SELECT user_id AS engine, ts, event_id AS seq, event_type IN ('view', 'purchase') AS own, count(*) FILTER (event_type = 'error') OVER w AS started,
         count(*) FILTER (event_type IN ('view', 'purchase') OR (event_type = 'click' AND event_id % 5 = 0)) OVER w AS requests, floor(value * 1000)::BIGINT AS tokens, event_type <> 'signup' AS loaded,
         count(*) FILTER (event_type IN ('view', 'purchase')) OVER w AS k, max(ts) OVER (PARTITION BY user_id) AS last_ts, max(ts) OVER () AS end_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
      o AS (SELECT *, ts + INTERVAL 6 HOUR AS due, lead(ts) OVER (PARTITION BY engine ORDER BY ts, seq) AS next_ts FROM r WHERE own),
      b AS (SELECT o.engine, o.k, arg_min(r.ts, r.seq) AS ts, arg_min(CASE WHEN NOT r.loaded THEN 'unloaded' WHEN r.started <> o.started THEN 'restarted' ELSE 'foreign request' END, r.seq) AS what
            FROM o JOIN r ON r.engine = o.engine AND r.k = o.k AND NOT r.own AND (NOT r.loaded OR r.started <> o.started OR r.requests NOT IN (o.requests, o.requests - 1)) GROUP BY ALL)
    SELECT engine, b.ts AS at, b.what, o.seq AS conv, o.tokens FROM b JOIN o USING (engine, k)
    UNION ALL SELECT o.engine, due, 'idle', o.seq, o.tokens FROM o LEFT JOIN b USING (engine, k)
    WHERE o.tokens >= 16384 AND coalesce(b.ts, o.next_ts, due) >= due AND (last_ts >= due OR due <= end_ts - INTERVAL 1 HOUR)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Users as engines: views and purchases are calls of ours, every fifth click is another's, errors are restarts, signups unload.

    The stream is started anew for each half of the time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    kind, out = F.col("event_type"), scratch.folder(spark, "owners")
    own = kind.isin("view", "purchase")
    rows = read(spark, d, "events").select(
        F.col("user_id").alias("engine"), "ts", F.col("event_id").alias("seq"), F.when(own, F.col("event_id")).alias("conv"), F.count_if(kind == "error").over(w).alias("started"),
        F.count_if(own | ((kind == "click") & (F.col("event_id") % 5 == 0))).over(w).alias("requests"), F.floor(F.col("value") * 1000).alias("tokens"), (kind != "signup").alias("loaded"),
    )
    with owners.state_in_rocksdb(spark):
        for half in ("ts < '2024-01-16'", "ts >= '2024-01-16'"):
            rows.where(half).write.mode("append").parquet(f"{out}/rows")
            found = owners.owners(spark.readStream.schema(owners.INPUT).parquet(f"{out}/rows"), idle_seconds=6 * 3600)
            journal.drain(found, f"{out}/progress", f"{out}/found")
    return spark.read.parquet(f"{out}/found")
