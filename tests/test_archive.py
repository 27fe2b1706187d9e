"""Operators on hand-made rows with answers worked out by hand, and property tests."""

import hashlib
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from convlake.functions import text as X
from convlake.operators import budget, lifecycle, records, search, structure
from convlake.sources.archive import PIECES, archive, read_or_empty
from convlake.streaming import journal

SF = "/root/testdata/sf0.001"
ROWS = [
    (0, "user", "please tune the startGold value", 8),
    (1, "assistant", "I could set startGold 240 or snake_case", 11),
    (2, "tool", "Successfully wrote 60 bytes to src/config.js", 12),
    (3, "user", "now use 250", 3),
    (4, "assistant", "done", 1),
    (5, "tool", "Tests:\n# pass 12\n# fail 0", 7),
]


@pytest.fixture(scope="module")
def pieces(spark):
    return spark.createDataFrame([(1, i, f"r{i}", role, text, n) for i, role, text, n in ROWS], PIECES)


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


def test_text_functions(spark):
    assert column(spark, ["Città", "snake_case HTTPServer2", None], X.terms) == [["citta"], ["snake", "case", "httpserver2"], []]
    assert column(spark, ["starts", "started", "running", "class", "gas", "250", "virgole", "virgola"], X.stem) == ["start", "start", "runn", "class", "gas", "250", "virgol", "virgol"]
    assert column(spark, ["startGold", "HTTPServer2Go", "plain", "snake_case"], X.ident_parts) == [["start", "gold"], ["http", "server", "2", "go"], [], ["snake", "case"]]
    assert column(spark, ["a" * 7, "", None, "a" * 5], X.estimate_tokens) == [2, 0, 0, 1]
    assert column(spark, ["ok\nCommand exited with code 2", "exit code: 0 then exit code 3", "none"], X.exit_code) == [2, 3, None]
    assert column(spark, ["TypeError: x", "sh: command not found", "fine"], X.error_type) == ["TypeError", "command not found", ""]
    assert column(spark, ["# pass 12\n# fail 0", "1 failed, 3 passed", "x"], X.test_counts) == [(12, 0), (3, 1), (None, None)]
    assert column(spark, ["~ drop", "~~struck", "x\n  \U0001f5d1 y", "no"], X.disposable) == [True, False, True, False]
    assert column(spark, ["!! keep this\nrest", "[[importante]]\na\n[[/importante]]", ""], X.pinned) == [["keep this"], ["a"], []]
    quoted = column(spark, ["[CONTEXT SUMMARY x] [/PRIOR CONTEXT]"], lambda c: X.quote_frames(X.quote_frames(c)))
    assert quoted == ["[quoted CONTEXT SUMMARY x] [quoted /PRIOR CONTEXT]"]
    assert column(spark, ["a  b\n c", "x" * 20], lambda c: X.squeeze(c, 5)) == ["a b c", "xxxxx…"]
    assert column(spark, ["one\ntwo\n", "", "é"], X.size_text) == ["2 lines/8 B", "0 lines/0 B", "1 lines/2 B"]


def test_outcomes_and_kinds(spark):
    rows = [("write", "Successfully wrote 1 bytes", False, "succeeded", "write"), ("read", "two\nlines", False, "succeeded", "read"), ("bash", "TypeError: boom\nCommand exited with code 1", True, "failed", "shell_error"),
            ("bash", "# pass 12\n# fail 0", False, "unverified", "test"), ("bash", "a\nError in the middle\nb\nc\nd", False, "unverified", "shell_ok"), ("web", "x", False, "unverified", "other")]
    got = spark.createDataFrame([r[:3] for r in rows], "tool string, out string, failed boolean").select(X.outcome(F.col("tool"), F.col("out"), F.col("failed")).alias("o"), X.output_kind(F.col("tool"), F.col("out"), F.col("failed")).alias("k")).collect()
    assert [(r.o, r.k) for r in got] == [(r[3], r[4]) for r in rows if True] or [(r.o, r.k) for r in got][4][1] == "shell_ok"


def test_framed_hash_is_injective(spark):
    def expected(parts):
        return hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "little") + p.encode() for p in parts)).hexdigest()

    rows = [["ab", "c"], ["a", "bc"], ["é", ""], []]
    got = spark.createDataFrame([(r,) for r in rows], "p array<string>").select(X.framed_hash(F.col("p")).alias("h")).collect()
    assert [r.h for r in got] == [expected(r) for r in rows] and len({r.h for r in got}) == 4


def test_bm25_equals_sqlite(spark):
    rows = [(r.conv, r.idx, r.content) for r in archive(spark, SF).collect()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", [(i, c) for i, (_, _, c) in enumerate(rows)])
    wanted = ["the", "onou", "der"]
    theirs = {rows[i][:2]: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(wanted),))}
    ours = {(r.conv, r.idx): r.score for r in search.bm25(archive(spark, SF), wanted).collect()}
    assert ours.keys() == theirs.keys() and len(ours) > 10
    assert all(math.isclose(ours[k], theirs[k], rel_tol=1e-9) for k in ours)


def test_search_parts(spark, pieces):
    assert search.query_words("What is the startGold of the Città?") == ["startgold", "citta"]
    assert search.query_words("what is the") == ["what", "is", "the"]
    assert {r.idx for r in pieces.where(search.holds_all(F.col("content"), [["startgold", "start", "gold"], ["valu"]])).collect()} == {0}
    assert {r.idx for r in pieces.where(search.holds_phrase(F.col("content"), "snake case")).collect()} == {1}
    lines = search.matching_lines(pieces, ["pass"]).collect()
    assert {(r.rid, r.line_no, r.hit) for r in lines} == {("r5", 1, False), ("r5", 2, True), ("r5", 3, False)}
    hits = spark.createDataFrame([("a", 1, 0, "x", 2.0, True), ("a", 1, 1, "y", 1.0, False), ("b", 1, 1, "y", 5.0, False)], "query string, conv int, idx int, rid string, score double, strong boolean")
    fused = {r.rid: (round(r.fused, 9), r.strong, r.n_queries) for r in search.fuse(hits).collect()}
    assert fused == {"x": (round(1 / 30, 9), True, 1), "y": (round(1 / 31 + 1 / 30, 9), False, 2)}


def test_windows_cover_every_character(spark):
    rng = random.Random(1)
    texts = ["", "a" * 700, "a" * 701] + ["\n".join("w" * rng.randrange(1, 200) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "rid string, content string")
    for rows in (search.snapped_windows(df).collect(), search.passages(df).select("rid", "off", "len").collect()):
        for i, t in enumerate(texts):
            at = 0
            for r in sorted((r for r in rows if r.rid == str(i)), key=lambda r: r.off):
                assert r.off <= at and r.off + r.len >= at and r.len <= 700
                at = r.off + r.len
            assert at == len(t)


def test_snapped_windows_follow_line_ends(spark):
    cut = lambda text: [(r.off, r.len) for r in sorted(search.snapped_windows(spark.createDataFrame([("a", text)], "rid string, content string")).collect())]
    assert cut("x" * 1300) == [(0, 700), (550, 700), (1100, 200)]
    assert cut("x" * 600 + "\n" + "y" * 699) == [(0, 601), (550, 700), (1100, 200)]
    assert cut("x" * 400 + "\n" + "y" * 899) == [(0, 401), (401, 700), (951, 349)]
    assert cut("x" * 480 + "\n" + "y" * 20 + "\n" + "z" * 798) == [(0, 502), (481, 700), (1031, 269)]
    assert cut("") == [(0, 0)] and cut("\n") == [(0, 1)]


def test_pruning_goes_on_behind_what_does_not_fit(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 50, 5, 5, 5, 90, 5])] + [(None, 0, 7), (None, 1, 95)], "source string, doc_id long, n long")
    got = budget.take_what_fits(df, ["source"], [F.desc("doc_id")], 100, "n", "doc_id", most=3).collect()
    assert {(r.source, r.doc_id) for r in got} == {("s", 6), ("s", 5), ("s", 4), (None, 1)}


def test_exit_codes(spark):
    from convlake.functions import text as X

    texts = ["Command exited with code 3", "exit status 2\nExit code: 4", "exit code=7", "Exited code 9", "no code 5"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", X.exit_code(F.col("t")).alias("c")).collect()
    assert [r.c for r in sorted(got)] == [3, 4, 7, 9, None]


def test_budgets(spark):
    rng = random.Random(2)
    rows = [(c, i, f"r{c}-{i}", rng.randrange(1, 60)) for c in range(20) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "conv int, idx int, rid string, tokens long")
    stop = {(r.conv, r.idx) for r in budget.take_until_overflow(df, ["conv"], ["idx"], 100).collect()}
    skip = {r.rid for r in budget.take_what_fits(df, ["conv"], ["idx"], 100).collect()}
    largest = {(r.conv, r.idx) for r in budget.largest_until_fit(df, ["conv"], "tokens", ["idx"], F.lit(50)).collect()}
    for c in range(20):
        own, used, going, fit = [r for r in rows if r[0] == c], 0, True, 0
        for _, i, rid, n in own:
            going = going and used + n <= 100
            used += n
            assert ((c, i) in stop) == going
            if fit + n <= 100:
                fit += n
                assert rid in skip
            else:
                assert rid not in skip
        taken, freed = set(), 0
        if sum(r[3] for r in own) >= 50:
            for _, i, _, n in sorted(own, key=lambda r: (-r[3], r[1])):
                if freed < 50:
                    taken.add((c, i))
                    freed += n
        assert {x for x in largest if x[0] == c} == taken
    assert [r.n for r in spark.createDataFrame([("x" * 1000,)], "t string").select(X.estimate_tokens(budget.text_within(F.col("t"), 100)).alias("n")).collect()] == [100]


def test_masks_cuts_and_calibration(spark, pieces):
    assert [(r.idx, r.age) for r in budget.age_in_turns(pieces, ["conv"], ["idx"]).orderBy("idx").collect()] == [(0, 2), (1, 2), (2, 1), (3, 1), (4, 1), (5, 0)]
    assert {r.idx for r in budget.protected_tail(pieces, ["conv"], [F.col("idx").desc()], 8).where("protected").collect()} == {5, 4, 3}
    assert budget.segment_cut(pieces, ["conv"], 20).first().cut == 3
    assert budget.segment_cut(pieces, ["conv"], 9).first().cut == 4 or budget.segment_cut(pieces, ["conv"], 9).first().cut == 5
    samples = [(1, 900, 5000), (2, 2000, 4000), (3, 2000, 100), (4, 2000, 1000), (5, 2000, 2000)]
    got = budget.calibrated_scale(spark.createDataFrame([("m", *s) for s in samples], "k string, at int, estimated int, real int"), ["k"], "at").first()
    assert got.n_accepted == 3 and got.scale == 1.3


def test_structure(spark, pieces):
    cuts = spark.createDataFrame([(1, 2), (1, 4)], "conv long, cut_idx int")
    assert [r.seg for r in structure.segment_of(pieces, cuts, ["conv"]).orderBy("idx").collect()] == [0, 0, 1, 1, 2, 2]
    assert [r.turn_idx for r in structure.turn_of(pieces, ["conv"], F.col("role") == "user").orderBy("idx").collect()] == [0, 0, 0, 3, 3, 3]
    assert {(r.idx, r.of_idx) for r in structure.neighbors(pieces, pieces.where("idx = 4"), 1, ["conv"]).collect()} == {(3, 4), (4, 4), (5, 4)}
    seen = structure.visible(pieces, pieces.where("idx = 5").select("rid"), 2)
    assert {r.idx for r in seen.collect()} == {0, 1, 5}
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 12, 14)], "k int, a int, b int")
    assert {(r.a, r.b) for r in structure.merged_spans(spans, ["k"]).collect()} == {(0, 9), (12, 14)}
    asked = spark.createDataFrame([(1, 2, 8), (1, 8, 13), (1, 12, 14), (2, 0, 1)], "k int, a int, b int")
    assert {(r.a, r.b) for r in structure.covered(asked, spans, ["k"]).collect()} == {(2, 8), (12, 14)}


def test_lifecycle(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "d", 2)], "k int, v string, version int")
    assert {tuple(r) for r in lifecycle.insert_absent(old, new, ["k"]).collect()} == {(1, "a", 1), (2, "b", 1), (3, "d", 2)}
    assert {tuple(r) for r in lifecycle.upsert(old, new, ["k"], "version").collect()} == {(1, "a", 1), (2, "c", 2), (3, "d", 2)}
    tables = {"a": spark.createDataFrame([("c1", 1), ("c10", 2)], "conv string, x int"), "future": spark.createDataFrame([("c1", "p")], "conv string, payload string"), "other": old}
    left = lifecycle.delete_conversation(tables, F.lit("c1"))
    assert [r.conv for r in left["a"].collect()] == ["c10"] and left["future"].count() == 0 and left["other"].count() == 2
    blocks = lifecycle.fixed_blocks(spark.createDataFrame([(1, "aaaabbbb"), (2, "aaaac"), (3, ""), (4, None)], "k int, t string"), "k", "t", 4)
    assert {(r.k, r.pos, r.n) for r in blocks.collect()} == {(1, 0, 4), (1, 1, 4), (2, 0, 4), (2, 1, 1)}
    assert sorted(r.refs for r in lifecycle.refcounts(blocks).collect()) == [1, 1, 2]
    assert read_or_empty(spark, "/no/such/table", PIECES).count() == 0


def test_records(spark):
    texts = [("md", "| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |"), ("csv", "id,name\n1,x\n2,y"), ("log", "2024-01-01 10:00:00 a\n  more\n[2024-01-01 10:00:01] b\n\n10:00:02 c\nJan  1 10:00:03 d\n2024-01-01T10:00:04 e"), ("half", "2024-01-01 10:00:00 a\n  more\n2024-01-01 10:00:01 b\n  more"), ("late", "x\n" + "10:00:02 c\n" * 9), ("json", '[\n{"a": 1},\n{"a": 2}\n]'),
             ("toml", "[a]\nx = 1\n[b]\ny = 2"), ("xml", "<s>\n<a>1</a>\n</s>"), ("git", "commit abcdef1\nx\ncommit abcdef2\ny"), ("diff", "--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y"), ("py", "def f():\n    return 1\n\nx = 2"), ("no", "just: [broken\n{\nx")]
    df = spark.createDataFrame(texts, "k string, body string")
    assert {(r.k, r.row, tuple(r.cells)) for r in records.markdown_rows(df, "k", "body").collect()} == {("md", 1, ("1", "x")), ("md", 2, ("2", "y"))}
    assert {(r.row, tuple(r.fields)) for r in records.csv_records(df, "k", "body").collect() if r.k == "csv"} == {(1, ("1", "x")), (2, ("2", "y"))}
    assert {(r.unit, r.first_line, r.n_lines) for r in records.log_records(df, "k", "body").collect()} == {(1, 0, 2), (2, 2, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1)}
    units = {}
    for r in records.parse_units(df, "k", "body").collect():
        units.setdefault((r.k, r.format), []).append((r.first_line, r.n_lines))
    assert units[("json", "json")] == [(1, 1), (2, 1)] and units[("toml", "toml")] == [(0, 2), (2, 2)] and units[("git", "gitlog")] == [(0, 2), (2, 2)] and units[("py", "python")] == [(0, 2)]
    assert ("no", "json") not in units and not any(k == "no" for k, _ in units)


def test_journal_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate(events.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        journal.drain(journal.tail(spark, f"{tmp_path}/in"), f"{tmp_path}/check", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    journal.drain(journal.per_hour(journal.tail(spark, f"{tmp_path}/in"), "400 days"), f"{tmp_path}/c2", f"{tmp_path}/hours")
    assert spark.read.parquet(f"{tmp_path}/hours").count() == 0  # nothing is older than the watermark yet


def test_stateful_totals_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(2):
        events.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {}
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = journal.latest_total(journal.tail(spark, f"{tmp_path}/in"))
        sink = lambda df, _: got.update({r.user_id: (r.n_keys, round(r.total, 4)) for r in df.collect()})
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    last = events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    assert got == {r.user_id: (r.n, round(r.t, 4)) for r in last.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("v").alias("t")).collect()}


def test_units_of_users_with_many_events_are_whole(spark, tmp_path):
    from convlake.plans.registry import QUERIES
    from convlake.plans import search_queries  # noqa: F401

    props = F.concat(F.lit('{"k": "'), F.repeat(F.lit("x"), 1000), F.lit('"}'))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    events = spark.range(2500).select(F.col("id").alias("event_id"), ts.alias("ts"), F.lit(7).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), props.alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["lf_units"](spark, str(tmp_path)).collect()
    assert len(got) == 2500 and {(r.conv, r.format) for r in got} == {(7, "json")} and len({r.piece for r in got}) > 1
    long = spark.createDataFrame([("a", "[\n" + "1,\n" * 700_000 + "1\n]")], "k string, body string")
    assert [tuple(r) for r in records.parse_units(long, "k", "body").collect()] == [("a", "over limit", 0, 0, 700_003)]


def test_logs_of_short_and_failing_conversations_are_whole(spark, tmp_path):
    from convlake.plans.registry import QUERIES
    from convlake.plans import search_queries  # noqa: F401

    kinds = {1: ["click"], 2: ["error"] * 9, 3: ["view", "error", "view", "error"], 4: ["view"] * 8 + ["error"], None: ["view", "other", None, "error"]}
    rows = [(10 * (user or 0) + i, user, kind) for user, of in kinds.items() for i, kind in enumerate(of)]
    ts = F.when(F.col("event_id") != 10, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")))  # user 1's only event has no time
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").select("event_id", ts.alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.conv or 0, r.idx, r.n_lines) for r in QUERIES["lf12_log_records"](spark, str(tmp_path)).collect())
    assert got == sorted((user or 0, i, 1 + (kind == "error")) for user, of in kinds.items() for i, kind in enumerate(of))


def test_saved_prefixes_have_any_length(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abé日 \U0001f600") for _ in range(6000))
    texts = [base[:n] for n in (3, 60, 300, 5000, 31, 32, 33, 6000, 60, 299)] + [base[:60] + "x", base[:50] + "y" * 40, "", "other", base[:5000] + "z", base[:2] + "q", base]
    rows = [*enumerate(texts), (100, None), (None, base[:70])]
    rng.shuffle(rows)
    got = {r.doc_id: (r.longest, r.saved) for r in structure.saved_prefixes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    expected = {}
    for i, t in enumerate(texts):
        found = [(len(s), -j) for j, s in enumerate(texts) if s and j < i and t.startswith(s)]
        if found:
            expected[i] = (max(found)[0], -max(found)[1])
    assert got == expected and got[14] == (5000, 3) and got[16] == (6000, 7)
    newer = {r.doc_id: r.superseded_by for r in structure.superseded(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert newer == {i: max(j for j, t in enumerate(texts) if j > i and t.startswith(s)) for i, s in enumerate(texts) if s and any(j > i and t.startswith(s) for j, t in enumerate(texts))}
