"""Imports of messages and checks of call arguments; the JSON is made of the given conversations, whose texts it must give back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.operators import messages
from convlake.plans.registry import query
from convlake.sources.archive import archive

#: What counts as a mark and as a cut line in texts that hold no receipts: three words in a row, a line of one word.
MARKS, ONE_WORD_LINE = "tion (?:the|de|der) ", r"(?m)^[ \t]*\p{Lu}\p{L}+\.[ \t]*$"


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _block(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *(c.alias(k) for k, c in fields.items())))


def _object(**fields: Column) -> Column:
    """An object of fields that are JSON already."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), c) for k, c in fields.items())), F.lit("}"))


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


@query(
    "pf12_contaminated_calls",
    f"WITH <archive> SELECT conv, idx FROM archive WHERE idx % 3 <> 1 AND (regexp_matches(content, '{MARKS}') OR regexp_matches(content, '{ONE_WORD_LINE}'))",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Arguments hold a message as text, as JSON in a string, and as JSON in a string in JSON in a string, by conversation."""
    once = F.to_json(F.struct(F.col("rid").alias("path"), "content"))
    twice = F.to_json(F.struct(F.lit("sed").alias("cmd"), once.alias("patch")))
    thrice = F.to_json(F.struct(F.array(twice, F.lit("[")).alias("batch")))
    args = F.when(F.col("conv") % 4 == 0, F.col("content")).when(F.col("conv") % 4 == 1, once).when(F.col("conv") % 4 == 2, twice).otherwise(thrice)
    calls = archive(spark, d).select("conv", "idx", F.get(F.array(*map(F.lit, ("Write", "read", "bash"))), F.col("idx") % 3).alias("name"), args.alias("args"))
    return messages.contaminated_calls(calls, ["conv", "idx"], marks=MARKS, cut_line=ONE_WORD_LINE)


def _flat(found: DataFrame) -> DataFrame:
    call = F.get("tool_calls", F.lit(0))
    return found.select("conv", "idx", "part", "role", "content", "reasoning", "tool_call_id", F.size("tool_calls").alias("n_calls"), call["name"].alias("call_name"), call["arguments"].alias("arguments"))


@query(
    "sc16_block_messages",
    """WITH <archive> SELECT conv, idx, part::INT AS part, role, content, reasoning, tool_call_id, n_calls, call_name, arguments FROM (
       SELECT conv, idx, 0 AS part, role, content, NULL AS reasoning, NULL AS tool_call_id, 0 AS n_calls, NULL AS call_name, NULL AS arguments FROM archive WHERE role = 'user' AND idx % 4 = 0
       UNION ALL SELECT conv, idx, 0, 'user', substr(content, 1, 20) || substr(content, 21, 5), NULL, NULL, 0, NULL, NULL FROM archive WHERE role = 'user' AND idx % 4 <> 0
       UNION ALL SELECT conv, idx, 1, 'tool', CASE WHEN conv % 2 = 0 THEN 'Error: ' ELSE '' END || substr(content, 26, 60) || '[image]', NULL, 'c' || idx, 0, NULL, NULL FROM archive WHERE role = 'user' AND idx % 4 <> 0
       UNION ALL SELECT conv, idx, 2, 'tool', substr(content, 86, 60), NULL, 'd' || idx, 0, NULL, NULL FROM archive WHERE role = 'user' AND idx % 4 <> 0
       UNION ALL SELECT conv, idx, 3, 'user', substr(content, 146), NULL, NULL, 0, NULL, NULL FROM archive WHERE role = 'user' AND idx % 4 <> 0
       UNION ALL SELECT conv, idx, 0, role, substr(content, 11), substr(content, 1, 10), NULL, 2, 'Read', '{"limit":' || idx || ',"path":"src/' || conv || '"}' FROM archive WHERE role = 'assistant')""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Users' messages as strings or as texts around two results (a failed one with a picture, a plain one), assistants' as thought, text and calls."""
    part = lambda at, n: F.substring("content", at, n)
    rest = lambda at: F.expr(f"substring(content, {at})")
    result = _object(
        type=_quoted(F.lit("tool_result")), tool_use_id=_quoted(F.concat(F.lit("c"), "idx")), is_error=F.when(F.col("conv") % 2 == 0, "true").otherwise("false"),
        content=_list(_block("text", text=part(26, 60)), _block("image", data=F.lit("..."))),
    )
    second = _block("tool_result", tool_use_id=F.concat(F.lit("d"), "idx"), content=part(86, 60))
    user = _list(_block("text", text=part(1, 20)), _block("text", text=part(21, 5)), result, second, _block("text", text=rest(146)))
    call = _object(type=_quoted(F.lit("tool_use")), name=_quoted(F.lit("Read")), input=F.to_json(F.struct(F.concat(F.lit("src/"), "conv").alias("path"), F.col("idx").alias("limit"))))
    assistant = _list(_block("thinking", thinking=part(1, 10)), _block("redacted_thinking", data=F.lit("x")), _block("text", text=rest(11)), call, call)
    content = F.when((F.col("role") == "user") & (F.col("idx") % 4 == 0), _quoted(F.col("content"))).when(F.col("role") == "user", user).otherwise(assistant)
    rows = archive(spark, d).select("conv", "idx", _object(role=_quoted(F.col("role")), content=content).alias("message"))
    return _flat(messages.block_messages(rows))


@query(
    "sc11_session_import",
    """WITH <archive> SELECT conv, idx, 0::INT AS part, CASE WHEN role = 'system' THEN 'tool' ELSE role END AS role,
         CASE role WHEN 'user' THEN substr(content, 1, 30) || chr(10) || substr(content, 31) WHEN 'assistant' THEN substr(content, 11) ELSE content END AS content,
         CASE WHEN role = 'assistant' THEN substr(content, 1, 10) END AS reasoning, CASE WHEN role = 'system' THEN 'c' || conv END AS tool_call_id,
         CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls, CASE WHEN role = 'assistant' THEN 'edit' END AS call_name,
         CASE WHEN role = 'assistant' THEN '{"n":' || idx || '}' END AS arguments
       FROM archive WHERE idx % 5 <> 4""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Session lines: users' texts in two parts, assistants' thought, text and call, what systems say as a tool's result; each fifth line is a compaction."""
    part, rest = (lambda at, n: F.substring("content", at, n)), (lambda at: F.expr(f"substring(content, {at})"))
    user = _object(role=_quoted(F.lit("user")), content=_list(_block("text", text=part(1, 30)), _block("text", text=rest(31))))
    call = _object(type=_quoted(F.lit("toolCall")), id=_quoted(F.lit("k")), name=_quoted(F.lit("edit")), arguments=F.to_json(F.struct(F.col("idx").alias("n"))))
    assistant = _object(role=_quoted(F.lit("assistant")), content=_list(_block("thinking", thinking=part(1, 10)), _block("text", text=rest(11)), call))
    tool = _object(role=_quoted(F.lit("toolResult")), toolCallId=_quoted(F.concat(F.lit("c"), "conv")), content=_list(_block("text", text=F.col("content")), _block("image", data=F.lit("QUJD"))))
    message = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(tool)
    line = F.when(F.col("idx") % 5 == 4, _block("compaction", tokensBefore=F.col("tokens"))).otherwise(_object(type=_quoted(F.lit("message")), message=message))
    return _flat(messages.agent_messages(archive(spark, d).select("conv", "idx", line.alias("line"))))
