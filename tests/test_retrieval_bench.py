"""The retrieval bench on hand-made answers: groups of evidence, the order of calls, places, negatives; and its search against single searches."""

from convlake.operators import retrieval_bench as R
from convlake.operators import search


def rows(spark, *, questions, evidence, calls, shown):
    q = spark.createDataFrame(questions, "qid int, kind string, neg boolean")
    e = spark.createDataFrame(evidence, "qid int, grp int, rids array<string>, pattern string")
    c = spark.createDataFrame(calls, "qid int, call int")
    s = spark.createDataFrame(shown, "qid int, call int, place int, rid string, strong boolean, text string, tokens long")
    return R.scores(q, e, c, s)


def test_scores(spark):
    questions = [(1, "a", False), (2, "a", False), (3, "b", False), (4, "b", True), (5, "b", True), (6, None, False), (7, "a", False)]
    evidence = [
        (1, 0, ["r1", "r2"], r"port \d+"), (1, 1, ["r3"], "say \"hi\""),
        (2, 0, ["r1"], "x.y"), (3, 0, ["r9"], "deep"), (7, 0, ["r1"], "elsewhere"),
    ]
    calls = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (5, 1), (5, 2), (7, 1), (3, 6)]
    shown = [
        (1, 1, 1, "r0", False, "port 80", 10), (1, 1, 2, "r2", True, "port\n 81", 5), (1, 2, 1, "r3", False, 'say \\"hi\\"', 7), (1, 3, 1, "r3", False, "unused", 100),
        (2, 1, 1, "r1", False, "x\ny", 4), (3, 1, 6, "r9", False, "deep", 1), (3, 1, 1, "r8", False, "no", 1),
        (5, 2, 1, "r1", True, "strong", 3), (7, 1, 1, "r1", False, "not this", 2), (7, 1, 2, "r2", False, "elsewhere here", 2),
    ]
    got = {r.qid: (r.n_groups, r.covered, r.e5, r.eb, r["rank"], round(r.rr, 3), r.n_calls, r.tokens, r.strong) for r in rows(spark, questions=questions, evidence=evidence, calls=calls, shown=shown).collect()}
    assert got == {
        1: (2, 2, False, True, 2, 0.5, 2, 22, True),  # the third call is not made
        2: (1, 1, True, True, 1, 1.0, 1, 4, False),  # a dot stands for a line end
        3: (1, 1, False, True, 6, 0.167, 1, 2, False),  # behind the first places
        4: (0, 0, False, False, None, 0.0, 1, 0, False),
        5: (0, 0, False, False, None, 0.0, 2, 3, True),
        6: (0, 0, False, False, None, 0.0, 0, 0, False),  # neither calls nor evidence
        7: (1, 1, True, True, 1, 1.0, 1, 4, False),  # the pattern is looked for in all that a call shows
    }
    total = [r for r in R.summary(rows(spark, questions=questions, evidence=evidence, calls=calls, shown=shown)).collect() if r.kind == "b"]
    assert [(r.n, r.e5, r.eb, r.neg_n, r.neg_ok) for r in total] == [(1, 0.0, 1.0, 2, 1)]
    assert rows(spark, questions=[], evidence=[], calls=[], shown=[]).collect() == []


def test_answers_equal_single_searches(spark):
    texts = ["alpha beta", "alpha alpha gamma", "Beta, gamma; beta", "", None, "delta " * 30, "alpha beta gamma", "alpha beta"]
    pieces = spark.createDataFrame([(i // 4, i, f"r{i}", t) for i, t in enumerate(texts)], "conv long, idx int, rid string, content string")
    asked = {(1, 1): ["alpha"], (1, 2): ["beta", "gamma", "beta"], (2, 1): ["delta", "nowhere"], (3, 1): ["nowhere"], (4, 1): []}
    calls = spark.createDataFrame([(*k, w) for k, w in asked.items()], "qid int, call int, words array<string>")
    got = {}
    for r in R.answers(pieces, calls, 3, 12).collect():
        got.setdefault((r.qid, r.call), []).append((r.place, r.rid, round(r.score, 6), r.strong, r.text))
    for k, words in asked.items():
        wanted = list(dict.fromkeys(words))
        found = search.bm25(pieces, wanted).collect() if wanted else []
        best = sorted(found, key=lambda r: (-round(r.score, 9), r.conv, r.idx))[:3]
        assert sorted(got.get(k, [])) == [(i + 1, r.rid, round(r.score, 6), r.n_terms == len(wanted), r.content[:12]) for i, r in enumerate(best)]
