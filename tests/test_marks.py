"""Users' marks: scanning twice, marks on exchanges, what is switched off, and the view's bounds; test reports with what is none."""

from convlake.operators import marks as M
from convlake.operators import reports as R

MESSAGES = "conv int, idx int, role string, content string"


def scanned(spark, messages, pins=(), drops=()):
    found = M.scan_marks(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(list(pins), "conv int, idx int, text string"), spark.createDataFrame(list(drops), "conv int, idx int"))
    return tuple(sorted(tuple(r) for r in df.collect()) for df in found)


def test_scanning_again_adds_nothing(spark):
    messages = [
        (1, 0, "user", "!! port 80\n!! port 80\n  \U0001f4cc second \nx !! no pin\n!!"), (1, 1, "assistant", "!! not a user's\n~ nor this"), (1, 2, "user", "~ away"), (1, 3, "user", "~~ struck ~~"),
        (1, 4, "user", None), (1, 5, "user", ""), (2, 0, "user", "[[importante]] a\nb [[/importante]]\n\U0001f5d1️ bin"),
    ]
    pins, drops = scanned(spark, messages)
    assert pins == [(1, 0, "port 80"), (1, 0, "second"), (2, 0, "a\nb")] and drops == [(1, 2), (2, 0)]
    assert scanned(spark, messages, pins, drops) == ([], [])
    assert scanned(spark, messages, pins[:1], drops[1:]) == (pins[1:], drops[:1])
    assert scanned(spark, [], pins, drops) == ([], [])


def test_marks_on_exchanges(spark):
    messages = spark.createDataFrame([(1, 0, "system", ""), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "assistant", "d")], MESSAGES)
    asked = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (1, 9), (2, 0), (3, 0)], "conv int, idx int")
    assert sorted(tuple(r) for r in M.exchanges(messages, asked).collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 9, 3)]


def test_actions_and_view(spark):
    messages = spark.createDataFrame([(1, i, "user", "é" * 400) for i in range(250)] + [(2, 0, "assistant", "x"), (3, 0, "user", None)], MESSAGES)
    pins = spark.createDataFrame([(1, 1, 0, "a" * 35, True), (1, 2, 0, "b" * 35, True), (1, 3, 5, "c", False), (3, 1, 0, "d", True)], "conv int, id int, idx int, text string, active boolean")
    actions = [(1, 1, 1, "update_pin", "first"), (1, 1, 2, "update_pin", " " + "e" * 70 + "\n "), (1, 1, 3, "update_pin", " \n"), (1, 2, 1, "unpin", None), (9, 9, 1, "unpin", None), (3, 1, 1, "update_pin", None)]
    changed = M.apply_actions(pins, spark.createDataFrame(actions, "conv int, id int, seq int, action string, text string"))
    assert {(r.conv, r.id): (r.text.strip(), r.active) for r in changed.collect()} == {(1, 1): ("e" * 70, True), (1, 2): ("b" * 35, False), (1, 3): ("c", False), (3, 1): ("d", True)}
    drops = spark.createDataFrame([(1, 3), (1, 3), (1, 999)], "conv int, idx int")
    view = {r.conv: r for r in M.marks_view(messages, changed, drops, 20).collect()}
    assert [(view[c].over_limit, len(view[c].pins), len(view[c].users)) for c in (1, 2, 3)] == [(view[1].pin_tokens > 20, 3, 200), (False, 0, 0), (False, 1, 1)]
    assert view[1].pin_tokens in (20, 21) and [(x.idx, x.text) for x in view[1].drops] == [(3, "é" * 300), (999, "")]
    assert (view[1].users[0].idx, view[1].users[-1].idx, view[1].users[0].text) == (50, 249, "é" * 240) and view[3].users[0].text == ""


REPORT = """============ test session starts ============
tests/a.py::test_one PASSED [ 10%]
tests/a.py::test_two[x y] FAILED [ 20%]

tests/b.py::test_x - XFAIL
============ FAILURES ============
____ test_two[x y] ____

    def test_two():
>       assert 1 == 2
E       assert 1 == 2

___ test_three ___
gone
=== short test summary ===
FAILED tests/a.py::test_two[x y] - assert 1 == 2
1 failed, 1 passed"""


def test_report_units(spark):
    none = ["a::b PASSED\nc::d FAILED\nprose", "PASSED tests\nFAILED\nERROR", None, "", "x", "text a::b PASSED\n text c::d PASSED\n e::f PASSED\ng::h PASSED"]
    texts = [REPORT, REPORT.replace("\n", "\r\n"), *none, "ERROR a.py::x\n" * 3, "___ a ___\nx::y PASSED\nx::y ERROR\nx::y SKIPPED"]
    got = {}
    for r in R.report_units(spark.createDataFrame(list(enumerate(texts)), "k int, body string"), "k", "body").collect():
        got.setdefault(r.k, []).append((r.a, r.b, r.kind, r.outcome, r.test))
    one = sorted(got[0])
    assert one == [
        (0, 1, "line", None, None), (1, 2, "line", "PASSED", "tests/a.py::test_one"), (2, 3, "line", "FAILED", "tests/a.py::test_two[x"), (4, 5, "line", "XFAIL", "tests/b.py::test_x"), (5, 6, "line", None, None),
        (6, 12, "block", "FAILED", "test_two[x y]"), (12, 14, "block", "FAILED", "test_three"), (14, 15, "line", None, None), (15, 16, "line", "FAILED", "tests/a.py::test_two[x"), (16, 17, "line", None, None),
    ]
    assert sorted(got[1]) == one
    assert sorted(got[8]) == [(i, i + 1, "line", "ERROR", "a.py::x") for i in range(3)]
    assert set(got) == {0, 1, 8}  # a single block is one unit only
