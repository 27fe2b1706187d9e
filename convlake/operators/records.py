"""Records of semi-structured texts: tables, logs, and the parsers that need Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import terms
from convlake.operators.search import equal_to

MAX_CHARS, OVER_LIMIT = 2_000_000, "over limit"
# How a line of a log begins.
STAMP = r"^\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2} +\d+ \d{2}:\d{2}:\d{2})"
UNITS = "format string, unit int, first_line int, n_lines int"


def _numbered(df: DataFrame, key: str, body: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(body, "\n")).alias("pos", "line"))


def markdown_rows(df: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of texts that are one Markdown table with a constant number of columns: key, row, cells, n_columns."""
    rows = _numbered(df, key, body).withColumn("cells", F.transform(F.split(F.regexp_replace(F.btrim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.btrim(x))).withColumn("n_columns", F.size("cells"))
    whole = Window.partitionBy(key)
    rows = rows.withColumn("same", F.min("n_columns").over(whole) == F.max("n_columns").over(whole)).withColumn("ruled", F.max((F.col("pos") == 1) & F.col("line").rlike(r"^[|\s:-]+$")).over(whole))
    return rows.where("same AND ruled AND pos > 1").select(key, (F.col("pos") - 1).alias("row"), "cells", "n_columns")


def csv_records(df: DataFrame, key: str, body: str) -> DataFrame:
    """Records of texts that are a CSV table (no quotes, a header that is no number, constant width of 2 or more): key, row, fields."""
    rows = _numbered(df, key, body).withColumn("fields", F.split("line", ",", -1))
    whole = Window.partitionBy(key)
    width = F.size("fields")
    ok = (F.min(width).over(whole) == F.max(width).over(whole)) & (F.min(width).over(whole) >= 2) & ~F.max(F.contains("line", F.lit('"'))).over(whole) & ~F.max((F.col("pos") == 0) & F.col("line").rlike(r"(^|,)\s*-?[0-9.]+\s*(,|$)")).over(whole)
    return rows.withColumn("ok", ok).where("ok AND pos > 0").select(key, F.col("pos").alias("row"), "fields")


def log_records(df: DataFrame, key: str, body: str, least_stamped: float = 0.8, least_lines: int = 4) -> DataFrame:
    """Records of logs: a line with a time stamp and the lines after it that have none: key, unit (from 1), first_line (from 0), n_lines.

    Blank lines do not count. A text is a log if at least least_stamped of its least_lines or more lines have a stamp, the first among them.
    """
    rows = _numbered(df, key, body).where(F.btrim("line") != "").withColumn("stamped", F.col("line").rlike(STAMP))
    log = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if("stamped").alias("n_stamped"), F.min_by("stamped", "pos").alias("first"))
    log = log.where(F.col("first") & (F.col("n") >= least_lines) & (F.col("n_stamped") >= least_stamped * F.col("n"))).select(F.col(key).alias("log_key"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    units = rows.join(log, F.col(key).eqNullSafe(F.col("log_key")), "left_semi").withColumn("unit", F.sum(F.col("stamped").cast("int")).over(w))
    return units.groupBy(key, "unit").agg(F.min("pos").alias("first_line"), F.count("*").alias("n_lines"))


def rank_units(units: DataFrame, key: str, unit: str, line: str, wanted: list[str], covered: bool = False) -> DataFrame:
    """BM25 of units within their own text, idf ln(1 + (N - df + 0.5) / (df + 0.5)): key, unit, score; with `covered` also how many wanted terms it holds."""
    toks = units.select(key, unit, terms(F.col(line)).alias("toks"))
    whole = Window.partitionBy(key)
    counts = [F.size(F.filter("toks", equal_to(w))) for w in wanted]
    rows = toks.select(key, unit, F.size("toks").alias("dl"), *(c.alias(f"f{i}") for i, c in enumerate(counts)))
    rows = rows.select("*", F.count("*").over(whole).alias("n"), F.avg("dl").over(whole).alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).over(whole).alias(f"df{i}") for i in range(len(wanted))))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, df = F.col(f"f{i}"), F.col(f"df{i}")
        part = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.try_divide("dl", "avgdl")))
        score = score + F.when(f > 0, part).otherwise(0.0)
    some = F.greatest(*(F.col(f"f{i}") for i in range(len(wanted)))) > 0 if len(wanted) > 1 else F.col("f0") > 0
    n_covered = sum(((F.col(f"f{i}") > 0).cast("long") for i in range(len(wanted))), F.lit(0))
    return rows.where(some).select(key, unit, F.round(score, 6).alias("score"), *([n_covered.alias("covered")] if covered else []))


def parse_units(df: DataFrame, key: str | list[str], body: str) -> DataFrame:
    """Smallest records of texts in a format that is sure: key columns, format, unit (from 1), first_line (from 0), n_lines.

    JSON lists and objects over several lines, TOML sections, XML with one construct a line, unified diffs, git logs, Python sources. Texts that
    fit none of them have no units. One that is longer than MAX_CHARS is not parsed; its one row has the format OVER_LIMIT, unit 0 and all lines.
    """
    keys = [key] if isinstance(key, str) else key
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for *k, text in zip(*(batch[c] for c in keys), batch[body]):
                if len(text or "") > MAX_CHARS:
                    rows.append((*k, OVER_LIMIT, 0, 0, text.count("\n") + 1))
                    continue
                name, units = _parse(text or "")
                rows += [(*k, name, i + 1, a, n) for i, (a, n) in enumerate(units)]
            yield pd.DataFrame(rows, columns=[*keys, "format", "unit", "first_line", "n_lines"])

    return df.select(*keys, body).mapInPandas(run, f"{kinds}, {UNITS}")


def _sections(lines: list[str], starts) -> list[tuple[int, int]]:
    at = [i for i, x in enumerate(lines) if starts(x)]
    return [(a, b - a) for a, b in zip(at, [*at[1:], len(lines)])]


def _json(text: str, lines: list[str]) -> list[tuple[int, int]]:
    import json

    if text.lstrip()[:1] not in ("{", "["):
        return []
    json.loads(text)
    return [(i, 1) for i, x in enumerate(lines) if x.strip().strip("{}[],")]


def _xml(text: str, lines: list[str]) -> list[tuple[int, int]]:
    from xml.etree import ElementTree

    if text.lstrip()[:1] != "<" or "<!ENTITY" in text:
        return []
    ElementTree.fromstring(text)
    return [(i, 1) for i, x in enumerate(lines) if "<" in x]


def _toml(text: str, lines: list[str]) -> list[tuple[int, int]]:
    import tomllib

    found = _sections(lines, lambda x: x.startswith("["))
    if len(found) > 1:
        tomllib.loads(text)
    return found if len(found) > 1 else []


def _gitlog(text: str, lines: list[str]) -> list[tuple[int, int]]:
    import re

    found = _sections(lines, lambda x: re.match(r"commit [0-9a-f]{7,40}\b", x))
    return found if len(found) > 1 and found[0][0] == 0 else []


def _diff(text: str, lines: list[str]) -> list[tuple[int, int]]:
    return _sections(lines, lambda x: x.startswith("@@ ")) if lines[0].startswith(("diff ", "--- ")) else []


def _python(text: str, lines: list[str]) -> list[tuple[int, int]]:
    import ast

    found = [x for x in ast.walk(ast.parse(text)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return sorted((x.lineno - 1, x.end_lineno - x.lineno + 1) for x in found)


FORMATS = {"json": _json, "xml": _xml, "toml": _toml, "gitlog": _gitlog, "diff": _diff, "python": _python}


def _parse(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The first format that has records and no doubt about it."""
    lines = text.split("\n")
    if len(lines) >= 3:
        for name, units in FORMATS.items():
            try:
                if found := units(text, lines):
                    return name, found
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                continue  # not of this format
    return "", []
