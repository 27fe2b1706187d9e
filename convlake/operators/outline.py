"""Structure of plain texts by their layout: columns that stand under each other, lines that are indented below others."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What parts two columns, and how a heading looks.
GAP, HEADING = r"\s{2,}", r"^[A-Z][A-Z0-9 _()/.%-]*$"
LEAST_COLUMNS, MOST_COLUMNS, LEAST_ROWS = 3, 63, 2


def column_tables(df: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of texts that are tables of aligned columns: key, line_no (from 0), cells, n_columns.

    The first line that is not blank has three or more headings in capitals, two spaces or more apart; at least two lines follow, and each has no
    more than one field less than there are headings. A column begins under its heading if the place before it is blank in every line:
    each line sets a bit for each heading, and the bits of all lines are and-ed. What is not parted so stays one cell, with the text of the
    columns that it runs into; the last column may be as long as it likes, or be missing. Keys are unique; blank lines are passed over.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n", -1)).alias("line_no", "line")).where(F.btrim("line") != "").withColumn("line", F.rtrim("line"))
    heads = lines.groupBy(key).agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("head_no"), F.count("*").alias("n"))
    heads = heads.withColumn("names", F.split(F.btrim("head"), GAP)).withColumn("n_columns", F.size("names"))
    heads = heads.where((F.col("n") > LEAST_ROWS) & F.col("n_columns").between(LEAST_COLUMNS, MOST_COLUMNS) & F.forall("names", lambda c: c.rlike(HEADING)))
    # where each heading begins: behind what comes before it, so that equal headings are told apart
    gaps = F.regexp_extract_all("head", F.lit(GAP), F.lit(0))
    first = F.length("head") - F.length(F.ltrim("head"))
    inner = F.when(F.substring("head", 1, 2) == "  ", F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))).otherwise(gaps)
    widths = F.zip_with(F.slice("names", F.lit(1), F.col("n_columns") - 1), inner, lambda c, g: F.length(c) + F.length(g))
    starts = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda i: first + F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    heads = heads.select(key, "head_no", "n_columns", F.explode(F.array(starts)).alias("starts"))
    rows = lines.join(heads, key)
    bit = lambda i: F.when((i == 0) | (F.substring("line", F.get("starts", i), F.lit(1)).isin(" ", "\t", "")), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    rows = rows.withColumn("bits", bits).withColumn("fields", F.size(F.split(F.btrim("line"), GAP)))
    tables = rows.groupBy(key).agg(F.bit_and("bits").alias("borders"), F.min("fields").alias("least")).join(heads.select(key, "n_columns"), key).where("least >= n_columns - 1").select(key, "borders")
    found = rows.where("line_no > head_no").join(tables, key)
    kept = F.filter(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda i: F.call_function("shiftrightunsigned", F.col("borders"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    cuts = F.transform(kept, lambda i: F.when(i == 0, 0).otherwise(F.get("starts", i)))
    found = found.withColumn("cuts", F.explode(F.array(cuts)))
    cells = F.transform("cuts", lambda at, k: F.btrim(F.substring("line", at + 1, F.coalesce(F.get("cuts", k + 1), F.length("line") + at + 1) - at)))
    return found.select(key, "line_no", cells.alias("cells"), "n_columns")


def indented_below(lines: list[str]) -> Iterator[tuple[int, int, list[int]]]:
    """(line, indent, lines that it stands below, outermost first) of the lines that are not blank: a stack of ever deeper lines."""
    stack: list[tuple[int, int]] = []
    for i, line in enumerate(lines):
        text = line.lstrip(" ")
        if text.strip():
            indent = len(line) - len(text)
            while stack and stack[-1][0] >= indent:
                stack.pop()
            yield i, indent, [at for _, at in stack]
            stack.append((indent, i))


def line_ancestors(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, line_no (from 0), indent, ancestors (line numbers, outermost first) of each line that is not blank. The nearest ancestor is the
    last line before that is indented less. Each text is one pass with a stack, in the task that reads it; a null text has no lines."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, line_no int, indent int, ancestors array<int>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(indented_below((batch.column(1)[i].as_py() or "").split("\n")))
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    keys = pa.array([batch.column(0)[i].as_py()] * len(some), batch.column(0).type)
                    columns = [pa.array(c, t) for c, t in zip(zip(*some), (pa.int32(), pa.int32(), pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, "line_no", "indent", "ancestors"])

    return df.select(key, F.col(body).cast("string")).mapInArrow(run, schema)
