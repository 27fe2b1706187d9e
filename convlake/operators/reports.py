"""Test reports in outputs: result lines and blocks of failures as units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How result lines, headings of failures and what ends them look, and how many there are at least.
RESULT = r"^\S+::\S+.*\b(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\b|^(FAILED|ERROR) \S+::"
HEADING, BORDER = r"^_{3,} .+ _{3,}$", r"^(_{3,}|={3,})"
LEAST_RESULTS, LEAST_UNITS = 3, 2


def report_units(df: DataFrame, key: str, body: str) -> DataFrame:
    """Units of texts that are test reports: key, a, b (lines [a, b), from 0), kind, outcome, test.

    A report has three or more result lines. block: a heading of a failure with all lines up to the next heading or rule, blank ones too;
    test is what the heading names, outcome FAILED. line: any other line that is not blank, with outcome and test where it is a result.
    A text of fewer than two units gives none; keys are unique, a null text has no lines. A line's block is found by the last border at or
    before it, one running maximum over a text's lines.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n", -1)).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"\r$", ""))
    border, text = F.when(F.col("line").rlike(BORDER), F.struct("at", F.col("line").rlike(HEADING).alias("heads"))), Window.partitionBy(key)
    rows = lines.withColumn("is_result", F.col("line").rlike(RESULT)).withColumn("last", F.max(border).over(text.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    unit = F.when(F.coalesce(F.col("last.heads"), F.lit(False)), F.col("last.at")).otherwise(F.when(F.btrim("line", F.lit(" \t\f\v")) != "", F.col("at")))
    rows = rows.withColumn("a", unit).withColumn("in_block", F.coalesce(F.col("last.heads"), F.lit(False))).withColumn("results", F.count_if("is_result").over(text)).where(F.col("results") >= LEAST_RESULTS)
    units = rows.where("a IS NOT NULL").groupBy(key, "a").agg((F.max("at") + 1).alias("b"), F.bool_or("in_block").alias("block"), F.min_by("line", "at").alias("line"))
    units = units.withColumn("units", F.count("*").over(text)).where(F.col("units") >= LEAST_UNITS)
    name = F.regexp_extract("line", r"^_{3,} (.+) _{3,}$", 1)
    ended, led = F.regexp_extract("line", RESULT, 1), F.regexp_extract("line", RESULT, 2)
    tested = F.when(ended != "", F.regexp_extract("line", r"^(\S+)", 1)).when(led != "", F.regexp_extract("line", r"^\S+ (\S+)", 1))
    return units.select(
        key, "a", "b", F.when(F.col("block"), "block").otherwise("line").alias("kind"),
        F.when(F.col("block"), "FAILED").otherwise(F.nullif(F.concat(ended, led), F.lit(""))).alias("outcome"), F.when(F.col("block"), name).otherwise(tested).alias("test"),
    )
