"""The registered queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The archive's tables in DuckDB's SQL.
ARCHIVE = """archive AS (
  SELECT conv_id AS conv, CAST(turn AS INT) AS idx, role, text AS content, CAST(floor(length(text) / 3.5 + 0.5) AS BIGINT) AS tokens,
         'r' || substr(sha256(conv_id::VARCHAR || ':' || turn::VARCHAR || ':' || text), 1, 12) AS rid FROM conversations)"""
OPS = """ops AS (
  SELECT user_id AS conv, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, event_id, ts, event_type,
         CASE event_type WHEN 'signup' THEN 'write' WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'read' ELSE 'bash' END AS op,
         'src/file' || json_extract_string(props, '$.k') || '.js' AS path, event_type = 'error' AS failed, value FROM events)"""
FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
TERMS = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may begin with the names of the tables above, in angle brackets."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql.replace("<archive>", ARCHIVE).replace("<ops>", OPS)
        return f

    return add
