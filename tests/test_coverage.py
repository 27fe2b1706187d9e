"""Recall results that older ones cover, against a search over all sets of witnesses."""

import itertools
import random

from convlake.operators import coverage as C


def copies(spark, rows):
    df = spark.createDataFrame(rows, f"conv int, idx int, text string, meta {C.META}, late boolean")
    out = C.verified_copies(df.withColumn("sources", C.sources(df["meta"], df["late"])), ["conv"])
    return {(r.conv, r.idx): (r.by, r.witnesses) for r in out.collect()}


def span(rid, a, n, **other):
    return {"rid": rid, "offset": a, "chars": n, **other}


def test_kinds_of_sources(spark):
    meta = [span("r", 3, 4), span("r", 3, 0), span("r", None, 4), span(None, 3, 4), span("", 3, 4), span("r", 3, 4, cut=True), span("r", 3, 4, grouped=True), {"rid": "r", "line_set": [5, 2, 5]}, {"rid": "r", "leaf_lines": [1]}, {"rid": "r", "line_set": []}]
    df = spark.createDataFrame([(meta, False), (meta, True), (None, None), ([], None)], f"meta {C.META}, late boolean")
    found = [r.s for r in df.select(C.sources(df["meta"], df["late"]).alias("s")).collect()]
    assert [s.kind for s in found[0]] == ["span", "opaque", "opaque", "opaque", "opaque", "cut", "opaque", "lines", "leaf", "opaque"]
    assert (found[0][0].a, found[0][0].b, found[0][7].lines, found[0][8].lines) == (3, 7, [2, 5], [1])
    assert [s.kind for s in found[1]] == ["cut", "cut", "cut", "opaque", "opaque", "cut", "cut", "cut", "cut", "cut"]
    assert found[2] == [] and found[3] == []


def test_text_and_joint_cover(spark):
    rows = [
        (1, 0, "one", [span("r", 0, 10)], None), (1, 1, "two", [span("r", 10, 10)], None), (1, 2, "both", [span("r", 5, 10)], None), (1, 3, "gap", [span("r", 5, 16)], None),
        (1, 4, "one", [span("x", 0, 10)], None), (1, 5, "other record", [span("q", 5, 10)], None), (1, 6, "half opaque", [span("r", 0, 5), {"rid": "r"}], None),
        (1, 7, "cut", [span("r", 0, 5)], True), (1, 8, " \n", [], None), (1, 9, " \n", None, None), (1, 10, "two sources", [span("r", 0, 5), span("r", 15, 6)], None), (1, 11, "again", [span("r", 5, 16)], None),
        (2, 20, "other talk", [span("r", 5, 10)], None), (1, 12, "lines", [{"rid": "r", "line_set": [1, 2]}], None), (1, 13, "leaf", [{"rid": "r", "leaf_lines": [1]}], None),
        (1, 14, "more", [{"rid": "r", "line_set": [3]}], None), (1, 15, "lines again", [{"rid": "r", "line_set": [3, 1]}, span("r", 0, 21)], None), (1, 16, None, [span("z", 0, 4), span("z", 2, 2)], None),
    ]
    assert copies(spark, rows) == {
        (1, 2): ("cover", [0, 1]), (1, 4): ("text", [0]), (1, 10): ("cover", [3, 6]), (1, 11): ("cover", [3]), (1, 15): ("cover", [0, 3, 12, 14]),
    }
    assert copies(spark, []) == {}


def test_fewest_witnesses(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, f"t{i}", [span(f"r{rng.randrange(2)}", rng.randrange(30), rng.randint(1, 9)) for _ in range(rng.choice((1, 1, 2)))], None) for i in range(120)]
    found = copies(spark, rows)
    assert any(len(w) > 1 for _, w in found.values())
    for conv, idx, _, meta, _ in rows:
        older = [(i, s) for c, i, _, m, _ in rows for s in m if c == conv and i < idx]
        fewest = []
        for s in meta:
            wanted = set(range(s["offset"], s["offset"] + s["chars"]))
            useful = [set(range(o["offset"], o["offset"] + o["chars"])) & wanted for _, o in older if o["rid"] == s["rid"]]
            useful = [u for u in set(map(frozenset, useful)) if u]
            fewest.append(next((n for n in range(1, len(wanted) + 1) for pick in itertools.combinations(useful, n) if frozenset().union(*pick) == wanted), None))
        assert ((conv, idx) in found) == all(n is not None for n in fewest)
        if len(meta) == 1 and fewest[0]:
            assert len(found[conv, idx][1]) == fewest[0]


def test_a_span_shown_by_very_many_results(spark):
    df = spark.range(200_000).selectExpr("1 AS conv", "CAST(id AS INT) AS idx", "CAST(id AS STRING) AS text", "array(named_struct('kind', 'span', 'rid', 'r', 'a', 0, 'b', 50, 'lines', CAST(NULL AS ARRAY<INT>))) AS sources")
    found = C.verified_copies(df, ["conv"])
    assert found.where("by = 'cover' AND witnesses = array(0L)").count() == 199_999
