"""JSON in messages and arguments: mixed types, nesting, escapes and what is no JSON."""

import json

from convlake.operators import messages as M


def strings_of(value, depth=1):
    """(depth, is_key, string) of a JSON value, in plain Python."""
    if isinstance(value, str):
        yield depth, False, value
        if value.lstrip()[:1] in ("{", "[", '"'):
            try:
                yield from strings_of(json.loads(value), depth + 1)
            except ValueError:
                pass
    elif isinstance(value, dict):
        for k, v in value.items():
            yield depth, True, k
            yield from strings_of(v, depth)
    elif isinstance(value, list):
        for v in value:
            yield from strings_of(v, depth)


def test_nested_strings_against_plain_python(spark):
    values = [
        {"a": json.dumps({"b": json.dumps(["deep\n…\nx", {"k": 5, "l": None}])}), "t": "plain"}, ["x", ["y", [["z", {"q": ["w"]}]]]], {}, [], 5, None, True, "", {"é": " \t\"\\"}, {"a": "[broken"},
        json.dumps(json.dumps(json.dumps({"u": "bottom"}))), {"m": '  {"n": "o"}'}, ["same", "same"],
    ]
    texts = [json.dumps(v, ensure_ascii=bool(i % 2)) for i, v in enumerate(values)] + ["no json", "{", ""]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, j string")
    found = sorted((r.i, r.depth, r.is_key, r.value) for r in M.nested_strings(df, ["i"], "j").collect())
    expected = [(i, depth, key, s) for i, t in enumerate(texts) for depth, key, s in strings_of(t, 0)]
    assert found == sorted(expected)
    assert M.nested_strings(df.limit(0), ["i"], "j").collect() == []


def test_contaminated_calls(spark):
    receipt = "⟪ctx-archive id=r0123456789ab kind=tool⟫"
    nest = lambda x, n: x if n == 0 else nest(json.dumps({"inner": x}), n - 1)
    cases = [
        ("write", nest(receipt, 1), True), ("Write", nest(receipt, 3), True), ("read", nest(receipt, 1), False), (None, nest(receipt, 1), False), ("bash", None, False), ("bash", receipt, True),
        ("edit", nest("a\n … \nb", 3), True), ("edit", nest("a … b", 3), False), ("edit", json.dumps({"…": 1, "b": ["x…"]}), False), ("edit", json.dumps({receipt: 1}), True),
        ("shell", nest("hidden to save space (12 tokens)", 2), True), ("shell", nest("hidden to save space (many tokens)", 2), False), ("write", nest("⟪ctx-archive id=r0123⟫", 2), False), ("write", "{}", False),
    ]
    calls = spark.createDataFrame([(i, name, args) for i, (name, args, _) in enumerate(cases)], "i int, name string, args string")
    assert sorted(r.i for r in M.contaminated_calls(calls, ["i"]).collect()) == [i for i, c in enumerate(cases) if c[2]]


def imported(spark, f, column, objects):
    rows = [(i, o if isinstance(o, str) or o is None else json.dumps(o)) for i, o in enumerate(objects)]
    out = {}
    for r in sorted(f(spark.createDataFrame(rows, f"i int, {column} string")).collect(), key=lambda r: (r.i, r.part)):
        out.setdefault(r.i, []).append((r.role, r.content, r.reasoning, [tuple(c) for c in r.tool_calls], r.tool_call_id, r.n_images, tuple(r.unsupported)))
    return out


def test_block_messages(spark):
    result = lambda i, content, **more: {"type": "tool_result", "tool_use_id": i, "content": content, **more}
    text = lambda t: {"type": "text", "text": t}
    found = imported(spark, M.block_messages, "message", [
        {"role": "user", "content": "hi"},
        {"role": "user", "content": [text("a"), "b", result("t1", "boom", is_error=True), result("t2", [text("x"), {"type": "image"}, "y"]), text("c"), {"type": "odd"}]},
        {"role": "user", "content": [result("t", " error: known", is_error=True), result("u", None)]},
        {"role": "assistant", "content": [{"type": "thinking", "thinking": "h"}, {"type": "thinking", "thinking": "m"}, text("o"), text("k"), {"type": "tool_use", "id": "q", "name": "Read", "input": {"z": [1, {"a": None}], "b": "é\"\n"}}, {"type": "server_tool_use", "id": "s", "name": "web"}]},
        {"role": "assistant", "content": "plain"}, {"role": "assistant", "content": []}, {"role": "user", "content": []}, {"role": "user", "content": None}, {"role": "system", "content": "s"}, [1], 5, "{", None, {"role": 7, "content": "x"},
        {"role": "user", "content": [text("only")]}, {"role": "user", "content": [{"type": "text"}, result(None, {"type": "text"})]},
    ])
    plain = lambda role, content: (role, content, None, [], None, 0, ())
    assert found == {
        0: [plain("user", "hi")],
        1: [("user", "ab", None, [], None, 0, ("odd",)), ("tool", "Error: boom", None, [], "t1", 0, ("odd",)), ("tool", "x[image]y", None, [], "t2", 1, ("odd",)), ("user", "c", None, [], None, 0, ("odd",))],
        2: [("tool", " error: known", None, [], "t", 0, ()), ("tool", "", None, [], "u", 0, ())],
        3: [("assistant", "ok", "hm", [("q", "Read", '{"b":"é\\"\\n","z":[1,{"a":null}]}'), ("s", "web", "{}")], None, 0, ())],
        4: [plain("assistant", "plain")], 5: [plain("assistant", "")], 14: [plain("user", "only")], 15: [plain("user", ""), ("tool", "", None, [], None, 0, ())],
    }


def test_agent_messages(spark):
    text = lambda t: {"type": "text", "text": t}
    line = lambda **m: {"type": "message", "timestamp": 1, "message": m}
    found = imported(spark, M.agent_messages, "line", [
        line(role="user", content=[text("a"), text("b")]),
        line(role="assistant", content=[{"type": "thinking", "thinking": "t"}, text("x"), text("y"), {"type": "toolCall", "id": "1", "name": "ls", "arguments": {"p": "."}}], usage={"input": 3}),
        line(role="toolResult", toolCallId="1", content=[text("out"), {"type": "image", "data": "..."}]),
        {"type": "compaction", "tokensBefore": 5}, "not json", None, line(role="other", content=[]), line(role="user", content="bare"),
    ])
    assert found == {
        0: [("user", "a\nb", None, [], None, 0, ())], 1: [("assistant", "xy", "t", [("1", "ls", '{"p":"."}')], None, 0, ())],
        2: [("tool", "out", None, [], "1", 1, ())], 7: [("user", "bare", None, [], None, 0, ())],
    }
