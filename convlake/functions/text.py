"""Column functions over text: tokens, identifiers, outcomes of calls, summaries of outputs. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing in a search, Italian and English.
STOP_WORDS = tuple(
    """il lo la i gli le un uno una di da in con su per tra fra e ed o ma che chi cosa come quando dove
quale quali quanto quanta quanti quante del dello della dei degli delle al allo alla ai agli alle dal dalla dai dalle
nel nello nella nei negli nelle sul sulla sui sulle è era erano sono sei hai avevi aveva ho ha abbiamo hanno c ci
si se non più anche poi prima dopo questo questa quello quella the a an of to in on for and or is was were are be
been what which who how why when where did do does it its this that these those with from at by as into than then""".split()
)
# Letters with marks and their base letters, for search terms.
MARKED, BASE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
# What outputs of commands say.
FAILED = r"(?m)RETRYABLE|not found in the current file|^Error|\bError:|Traceback|No such file|command not found|exit code [1-9]|exited with code [1-9]|ENOENT|EACCES"
SUCCEEDED = r"^\s*(Successfully|Created|Updated|Wrote|OK\b)"
EXIT = r"(?i)(?:exited with code |exit(?:ed)? (?:status|code)[:= ]+)(\d+)"
ERROR_OUTPUT = r"Error|error|ERR!|Traceback|failed|FAIL|not found|No such file|denied|Cannot|cannot|Unexpected|undefined|exception"
ERROR_LINE = r"(?i)\b(error|exception|traceback|failed|fatal)\b"
CHARS_PER_TOKEN = 3.5


def estimate_tokens(text: Column) -> Column:
    """Characters / 3.5, rounded half up; null counts as empty."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN + 0.5).cast("long")


def scaled_tokens(raw: Column, scale: Column | float) -> Column:
    return F.floor(raw * scale + 0.5).cast("long")


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, BASE)


def terms(text: Column) -> Column:
    """Search terms in order: runs of letters and digits, folded. An underscore parts terms."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(text: Column) -> Column:
    """Words in order, as they are written; an underscore belongs to a word."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def stem(word: Column) -> Column:
    """A light stem, the same for index and query: -ing or -ed, then a plural s, then a last vowel, as long as enough is left."""
    plain = word.rlike(r"^\p{L}+$") & (F.length(word) > 3)
    w = F.regexp_replace(word, r"^(.{4,})(?:ing|ed)$", "$1")
    w = F.regexp_replace(w, r"^(.{3,}[^s])s$", "$1")
    w = F.regexp_replace(w, "^(.{3,})[aeiouàèéìòù]$", "$1")
    return F.when(plain, w).otherwise(word)


def ident_parts(token: Column) -> Column:
    """The parts of a compound identifier in lower case (camel case, snake case); empty if it is not compound."""
    parts = F.transform(F.regexp_extract_all(token, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), F.lower)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def token_groups(text: Column) -> Column:
    """For each word an array: its stem, then the stems of its parts that differ from it."""
    return F.transform(words(text), lambda t: F.array_distinct(F.concat(F.array(stem(F.lower(t))), F.transform(ident_parts(t), stem))))


def identifiers(text: Column) -> Column:
    """Different tokens that look like names: with a digit, inner punctuation or an inner capital."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_][A-Za-z0-9_./-]*[A-Za-z0-9_]"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: t.rlike("[0-9]") | t.rlike("[A-Za-z0-9][_./-][A-Za-z0-9]") | t.rlike("[a-z][A-Z]")))


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))


def squeeze(text: Column, most: int) -> Column:
    """White space runs as one space, at most so many characters, with an ellipsis where it is cut."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.concat(F.substring(t, 1, most), F.when(F.length(t) > most, F.lit("…")).otherwise(F.lit("")))


def outcome(tool: Column, result: Column, failed: Column | None = None) -> Column:
    """'failed', 'succeeded' or 'unverified', from the first 600 characters of a result."""
    head = F.substring(F.coalesce(result, F.lit("")), 1, 600)
    bad = head.rlike(FAILED) if failed is None else (F.coalesce(failed, F.lit(False)) | head.rlike(FAILED))
    good = head.rlike(SUCCEEDED) | ((tool == "read") & (F.btrim(head) != ""))
    return F.when(bad, F.lit("failed")).when(good, F.lit("succeeded")).otherwise(F.lit("unverified"))


def exit_code(text: Column) -> Column:
    """The last exit code that an output names, else null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(EXIT), F.lit(1)), F.lit(-1)).cast("int")


def output_kind(tool: Column, result: Column, failed: Column) -> Column:
    """write, edit, read, test, shell_ok, shell_error or other."""
    tail = F.array_join(F.slice(F.reverse(F.split(F.btrim(result), "\n")), 1, 3), "\n")
    broken = tail.rlike(r"(?m)command not found|No such file|Traceback|^\w*Error\b")
    tested = result.rlike(r"(?m)^# (?:pass|fail) \d+|\d+ (?:passed|failed)")
    code = exit_code(result)
    shell = F.when(tested, "test").when(code.isNotNull(), F.when(code != 0, "shell_error").otherwise("shell_ok")).when(broken | failed, "shell_error").otherwise("shell_ok")
    return F.when(tool == "write", "write").when(tool == "edit", "edit").when(tool == "read", "read").when(tool == "bash", shell).otherwise("other")


def test_counts(text: Column) -> Column:
    """Numbers of passed and failed tests; the last summary counts."""
    last = lambda *patterns: F.coalesce(*(F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)).cast("int") for p in patterns))
    return F.struct(last(r"(?m)^# pass (\d+)", r"(\d+) passed").alias("passed"), last(r"(?m)^# fail (\d+)", r"(\d+) failed").alias("failed"))


def error_type(text: Column) -> Column:
    """The first name of an error or exception, else the kind of a shell failure, else empty."""
    named = F.regexp_extract(text, r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\b", 1)
    kind = F.regexp_extract(text, r"(command not found|No such file or directory|[Pp]ermission denied|npm ERR!|[Ss]egmentation fault)", 1)
    return F.when(named != "", named).otherwise(kind)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def full_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def last_line(text: Column, most: int = 200) -> Column:
    return squeeze(F.coalesce(F.try_element_at(full_lines(text), F.lit(-1)), F.lit("")), most)


def first_line(text: Column, most: int = 120) -> Column:
    return squeeze(F.coalesce(F.get(full_lines(text), F.lit(0)), F.lit("")), most)


def size_text(text: Column) -> Column:
    """Lines and UTF-8 bytes of an output."""
    n = F.octet_length(F.coalesce(text, F.lit("")))
    count = F.size(lines(text)) - F.when(F.coalesce(text, F.lit("")).endswith("\n") | (F.coalesce(text, F.lit("")) == ""), 1).otherwise(0)
    return F.concat(count.cast("string"), F.lit(" lines/"), F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / 1024, 1)), F.lit(" KB"))))


def pinned(text: Column) -> Column:
    """Lines that a user pins with a pin sign or !!, and marked blocks."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?si)\[\[importante\]\](.*?)\[\[/importante\]\]"), F.lit(1))
    rest = F.regexp_replace(text, r"(?si)\[\[importante\]\].*?\[\[/importante\]\]", "")
    found = F.concat(blocks, F.regexp_extract_all(rest, F.lit("(?m)^[ \\t]*(?:\U0001f4cc|!!)[ \\t]*(.+)$"), F.lit(1)))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def disposable(text: Column) -> Column:
    """Whether a line starts with a bin sign or one tilde."""
    return F.coalesce(text, F.lit("")).rlike("(?m)^[ \\t]*(?:\U0001f5d1\ufe0f?|~)(?!~)[ \\t]*\\S")


def quote_frames(text: Column) -> Column:
    """Relabels a client's control frames; doing it twice changes nothing."""
    return F.regexp_replace(text, r"\[(?!quoted )(/?)(OUT-OF-BAND USER MESSAGE|CONTEXT COMPACTION|CONTEXT SUMMARY|PRIOR CONTEXT)", "[quoted $1$2")


def path_matches(path: Column, wanted: Column) -> Column:
    """Equal paths, or one is the end of the other."""
    return (path == wanted) | path.endswith(wanted) | wanted.endswith(path)


def framed_hash(parts: Column) -> Column:
    """SHA-256 over an array of strings, each after its length in eight little-endian bytes, so that no two arrays share an input."""
    le8 = lambda x: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0"), F.lit(15) - 2 * i, F.lit(2))), ""))
    return F.sha2(F.aggregate(parts, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, le8(x), x.cast("binary"))), 256)
