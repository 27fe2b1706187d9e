"""Messages and call arguments as they arrive: JSON whose fields change their type, read as VARIANT.

Blocks of one message are taken apart and put together inside its row, so imports shuffle nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.sources import scratch

# Calls with effects, marks of receipts and placeholders, and a line that stands for what was cut.
GUARDED_NAMES = ("write", "edit", "bash", "multiedit", "notebookedit", "apply_patch", "exec_command", "shell")
RECEIPT_MARKS = (
    r"⟪ctx-archive id=[rta][0-9a-f]{12}|⟫ Ricevuta: |⟫ Receipt: |"
    r"\[gestore del contesto: richiamo automatico\] Pezzi|\[context manager: automatic recall\] Pieces|"
    r"nascosta per spazio \(\d+ token\)|hidden to save space \(\d+ tokens?\)"
)
CUT_LINE = r"(?m)^[ \t]*…[ \t]*$"

MESSAGE = "struct<role:string,content:string,reasoning:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,n_images:int>"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_list(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("ARRAY"), F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null if there is none or it is no string."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def as_list(v: Column) -> Column:
    """The elements of a list; of all else none."""
    return F.when(_is_list(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def nested_strings(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys, depth, is_key, value: every string in JSON texts, at any depth, also inside strings that are JSON texts themselves.

    depth counts the texts around a string: 0 for a text that is no JSON, 1 for a string in it, and so on. A string that is a JSON object or
    list is opened, too; it counts as a string of its own depth as well. Each level is written before the next is opened, so a deep text
    costs a pass over what is left, and no more.
    """
    spark = rows.sparkSession
    start = rows.where(F.col(json).isNotNull()).select(*keys, F.lit(0).alias("depth"), F.col(json).alias("value"))
    found = [start.select(*keys, "depth", F.lit(False).alias("is_key"), "value")]

    def opened(strings: DataFrame) -> DataFrame:
        v = F.try_parse_json("value")
        return strings.where(F.ltrim("value").rlike(r"^[\[{\"]")).select(*keys, F.col("depth") + 1, v).toDF(*keys, "depth", "v").where("v IS NOT NULL")

    level = scratch_table(opened(start), "json-level")
    while not level.isEmpty():
        inner = level.where(_is_list(F.col("v")) | _is_object(F.col("v"))).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        inner = inner.select(*keys, "depth", F.col("key").alias("name"), F.col("value").alias("v"))
        strings = inner.where(_kind(F.col("v")) == "STRING").select(*keys, "depth", F.try_variant_get("v", "$", "string").alias("value"))
        bare = level.where(_kind(F.col("v")) == "STRING").select(*keys, "depth", F.try_variant_get("v", "$", "string").alias("value"))
        strings = scratch_table(strings.unionByName(bare), "json-strings")
        names = inner.where("name IS NOT NULL").select(*keys, "depth", F.lit(True).alias("is_key"), F.col("name").alias("value"))
        found += [strings.select(*keys, "depth", F.lit(False).alias("is_key"), "value"), names]
        deeper = inner.where(_is_list(F.col("v")) | _is_object(F.col("v"))).select(*keys, "depth", "v")
        level = scratch_table(deeper.unionByName(opened(strings)), "json-level")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contaminated_calls(calls: DataFrame, keys: list[str], name: str = "name", args: str = "args", marks: str = RECEIPT_MARKS, cut_line: str = CUT_LINE) -> DataFrame:
    """The keys of calls with effects whose arguments hold a copied receipt, a placeholder or a cut line, however deep and however escaped.

    Arguments are a JSON text or any other one. A mark counts in keys and in strings, a cut line in strings only. Null names and arguments
    are never contaminated.
    """
    guarded = calls.where(F.lower(name).isin(*GUARDED_NAMES)).select(*keys, args)
    strings = nested_strings(guarded, keys, args)
    return strings.where(F.col("value").rlike(marks) | (~F.col("is_key") & F.col("value").rlike(cut_line))).select(*keys).distinct()


# ---------------------------------------------------------------- imports
def _message(role: Column | str, content: Column, reasoning: Column | None = None, calls: Column | None = None, call_id: Column | None = None, images: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    return F.struct(
        (F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"), (nothing if reasoning is None else reasoning).alias("reasoning"), (none if calls is None else calls).alias("tool_calls"),
        (nothing if call_id is None else call_id).alias("tool_call_id"), (F.lit(0) if images is None else images).cast("int").alias("n_images"),
    ).cast(MESSAGE)


def _of_type(blocks: Column, *types: str) -> Column:
    return F.filter(blocks, lambda b: F.coalesce(text_at(b, "$.type"), F.lit("")).isin(*types))


def _joined(blocks: Column, field: str, between: str = "") -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(text_at(b, f"$.{field}"), F.lit(""))), between)


def _text_of(content: Column, image_note: str) -> Column:
    """The text of a string or of a list of blocks and strings."""
    one = lambda b: F.when(_kind(b) == "STRING", F.try_variant_get(b, "$", "string")).when(text_at(b, "$.type").isin("image", "document"), F.lit(image_note)).otherwise(F.coalesce(text_at(b, "$.text"), F.lit("")))
    return F.coalesce(F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")), F.array_join(F.transform(as_list(content), one), ""))


def _calls(blocks: Column, types: tuple[str, ...], arguments: str) -> Column:
    def call(b: Column) -> Column:
        given = F.try_variant_get(b, f"$.{arguments}", "variant")
        return F.struct(text_at(b, "$.id").alias("id"), text_at(b, "$.name").alias("name"), F.coalesce(F.to_json(given), F.lit("{}")).alias("arguments"))

    return F.transform(_of_type(blocks, *types), call)


def block_messages(rows: DataFrame, message: str = "message", image_note: str = "[image]") -> DataFrame:
    """rows with part and the fields of a canonical message for each that a block message stands for, in order.

    A user's blocks become one message for the text before each tool result, one for the result (an error says so in its first word),
    and one for the text behind the last. An assistant's blocks become one message: text, reasoning and calls, whose arguments are compact
    JSON with sorted keys. Text content is taken as it is. What is no JSON object, or has another role, has no message. unsupported names the
    types of blocks that are passed over.
    """
    m = F.try_parse_json(message)
    rows = rows.withColumn("_m", m).withColumn("_role", text_at(F.col("_m"), "$.role")).withColumn("_content", F.try_variant_get("_m", "$.content", "variant"))
    rows = rows.withColumn("_blocks", as_list(F.col("_content")))
    blocks, content = F.col("_blocks"), F.col("_content")
    plain = F.when(_kind(content) == "STRING", F.array(_message(F.col("_role"), F.try_variant_get(content, "$", "string"))))
    is_result = lambda b: F.coalesce(text_at(b, "$.type") == "tool_result", F.lit(False))
    at = F.transform(blocks, lambda b, i: F.when(is_result(b), i + 1))
    bounds = F.concat(F.array(F.lit(0)), F.filter(at, lambda i: i.isNotNull()), F.array(F.size(blocks) + 1))

    def user_part(k: Column) -> Column:
        low, high = F.get(bounds, k), F.get(bounds, k + 1)
        texts = F.slice(blocks, low + 1, F.greatest(high - low - 1, F.lit(0)))
        before = F.when(high - low > 1, F.array(_message("user", F.array_join(F.transform(texts, lambda b: F.coalesce(F.when(_kind(b) == "STRING", F.try_variant_get(b, "$", "string")), text_at(b, "$.text"), F.lit(""))), ""))))
        result = F.get(blocks, high - 1)
        inner = F.try_variant_get(result, "$.content", "variant")
        said = _text_of(inner, image_note)
        failed = F.coalesce(F.try_variant_get(result, "$.is_error", "boolean"), F.lit(False)) & ~F.lower(F.ltrim(said)).startswith("error")
        images = F.size(_of_type(as_list(inner), "image", "document"))
        tool = F.when(high <= F.size(blocks), F.array(_message("tool", F.when(failed, F.concat(F.lit("Error: "), said)).otherwise(said), call_id=text_at(result, "$.tool_use_id"), images=images)))
        none = F.array().cast(f"array<{MESSAGE}>")
        return F.concat(F.coalesce(before, none), F.coalesce(tool, none))

    user = F.flatten(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), user_part))
    thinking = _of_type(blocks, "thinking")
    assistant = F.array(_message("assistant", _joined(_of_type(blocks, "text"), "text"), F.when(F.size(thinking) > 0, _joined(thinking, "thinking")), _calls(blocks, ("tool_use", "server_tool_use"), "input")))
    listed = _is_list(content)
    messages = F.when(F.col("_role").isin("user", "assistant"), F.coalesce(plain, F.when(listed & (F.col("_role") == "user"), user), F.when(listed, assistant)))
    known = F.when(F.col("_role") == "user", F.array(*map(F.lit, ("text", "tool_result")))).otherwise(F.array(*map(F.lit, ("text", "thinking", "redacted_thinking", "tool_use", "server_tool_use"))))
    types = F.transform(blocks, lambda b: F.when(_kind(b) == "STRING", F.lit("text")).otherwise(F.coalesce(text_at(b, "$.type"), F.lit(""))))
    rows = rows.withColumn("unsupported", F.array_distinct(F.array_except(types, known)))
    return _parts(rows, messages)


def agent_messages(rows: DataFrame, line: str = "line") -> DataFrame:
    """The same of lines of an agent's session file: objects with type and message, whose parts are texts, thoughts, calls and images.

    A user's texts are joined by line ends, an assistant's without anything; a tool's result keeps its text and the number of its images. Lines
    without a message, compactions and what is no JSON object have none.
    """
    rows = rows.withColumn("_m", F.try_variant_get(F.try_parse_json(line), "$.message", "variant")).withColumn("_role", text_at(F.col("_m"), "$.role"))
    rows = rows.withColumn("_content", F.try_variant_get("_m", "$.content", "variant")).withColumn("_blocks", as_list(F.col("_content")))
    blocks, role = F.col("_blocks"), F.col("_role")
    texts, thinking = _of_type(blocks, "text"), _of_type(blocks, "thinking")
    plain = F.when(_kind(F.col("_content")) == "STRING", F.try_variant_get("_content", "$", "string"))
    user = _message("user", F.coalesce(plain, _joined(texts, "text", "\n")))
    assistant = _message("assistant", F.coalesce(plain, _joined(texts, "text")), F.when(F.size(thinking) > 0, _joined(thinking, "thinking")), _calls(blocks, ("toolCall",), "arguments"))
    tool = _message("tool", F.coalesce(plain, _joined(texts, "text")), call_id=text_at(F.col("_m"), "$.toolCallId"), images=F.size(_of_type(blocks, "image")))
    known = F.array(*map(F.lit, ("text", "thinking", "toolCall", "image")))
    types = F.transform(blocks, lambda b: F.coalesce(text_at(b, "$.type"), F.lit("")))
    rows = rows.withColumn("unsupported", F.array_distinct(F.array_except(types, known)))
    return _parts(rows, F.when(role == "user", F.array(user)).when(role == "assistant", F.array(assistant)).when(role == "toolResult", F.array(tool)))


def _parts(rows: DataFrame, messages: Column) -> DataFrame:
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*kept, F.posexplode(messages).alias("part", "_said")).select(*kept, "part", "_said.*")
