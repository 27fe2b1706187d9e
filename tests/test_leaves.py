"""The choice of units against plain Python, and shared room against a loop."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from convlake.operators import leaves as L


def plain_choice(units, question, strict=False, opposites=()):
    words, identifiers = L.question_terms(question)
    if not words and not identifiers:
        return [], "no word"
    toks = {u: [w for w in re.findall(L.WORD, (t or "").lower()) if len(w) > 1 or w.isdigit()] for u, t, _ in units}
    counts = {u: [toks[u].count(w) for w in words] + [len(re.findall(rf"(?<![\w\-.]){re.escape(i)}(?![\w\-])", (t or "").lower())) for i in identifiers] for u, t, _ in units}
    n, mean = len(units), sum(map(len, toks.values())) / len(units) or 1.0
    df = [sum(c[i] > 0 for c in counts.values()) for i in range(len(words) + len(identifiers))]
    against = {w for p in opposites for w, o in (p, p[::-1]) if o in words and w not in words}
    ranked = []
    for u, _, path in units:
        got = {i for i, f in enumerate(counts[u]) if f}
        score = sum((1 if i < len(words) else 2) * math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)) * (f := counts[u][i]) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks[u]) / mean)) for i in got)
        if set(re.findall(L.WORD, (path or "").lower())) & against:
            score *= 0.35
        ranked.append((-sum(2 * df[i] <= n for i in got), -round(score, 9), u, got))
    ranked.sort(key=lambda r: r[:3])
    cov, score, _, got = ranked[0]
    if score >= 0 or not got:
        return [], "no word found"
    telling = [i for i in got if df[i] <= max(10, n // 4)]
    if not telling:
        return [], "no telling word"
    if strict and not (len(got) >= 2 or any(i >= len(words) or df[i] <= 3 for i in telling)):
        return [], "weak match"
    equal = [r[2] for r in ranked if r[1] < 0 and r[3] >= got]
    if len(equal) > 10:
        return [], f"{len(equal)} equal blocks"
    near = [r[2] for r in ranked if r[2] not in equal and r[0] <= cov and -r[1] >= 0.9 * -score and not r[3] <= got]
    return (equal + near)[:10], ""


QUESTIONS = ["port of orders-db", "alpha beta", "alpha", "gamma 7 delta", "the of", "", "zeta", "primary alpha", "what is rateCeiling in config.yaml", "x1 orders-db:80", "beta"]


def texts(rng, n_texts=12):
    names = ["alpha", "beta", "gamma", "delta", "orders-db", "7", "x1", "primary", "replica", "rateCeiling", "the", "port", "config", "é"]
    out = []
    for t in range(n_texts):
        some = rng.sample(names, rng.randint(2, len(names)))
        out += [(t, u, rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice(some) for _ in range(rng.randint(0, 6))), rng.choice(["primary", "Replica:", None])) for u in range(rng.choice([1, 4, 30]))]
    return out + [(99, u, "alpha" if u < 12 else "port", None) for u in range(62)]


@pytest.mark.parametrize("strict", [False, True])
def test_choice_against_plain_python(spark, strict):
    rows = texts(random.Random(11))
    df = spark.createDataFrame(rows, "t int, u int, text string, path string").cache()
    opposites = (("primary", "replica"),)
    reasons = set()
    for question in QUESTIONS:
        found = {r.t: (r.units, r.reason) for r in L.choose(df, "t", "u", "text", question, strict, "path", opposites).collect()}
        expected = {t: plain_choice([(u, x, p) for k, u, x, p in rows if k == t], question, strict, opposites) for t in {r[0] for r in rows}}
        assert found == expected, question
        reasons |= {re.sub(r"\d+", "n", r) for _, r in found.values()}
    assert reasons >= {"", "no word", "no word found", "weak match" if strict else "n equal blocks"} and ("weak match" in reasons) == strict


def test_query_and_question_together(spark):
    rows = texts(random.Random(3), 8)
    df = spark.createDataFrame(rows, "t int, u int, text string, path string").cache()
    guides = set()
    for query, question in (("alpha", ""), ("", "alpha"), ("alpha", "gamma delta"), ("orders-db", "port 7"), ("x1", "nothing here"), ("", ""), ("zeta", "alpha beta")):
        expected = {}
        for t in {r[0] for r in rows}:
            units = [(u, x, p) for k, u, x, p in rows if k == t]
            q, s, b = plain_choice(units, query)[0], plain_choice(units, question, True)[0], plain_choice(units, f"{query} \n {question}")[0] if question else []
            if query:
                if len(q) == 1:
                    picked = (q + s, ["query", "question"]) if s and len(s) <= 2 and q[0] not in s else (q, ["query"])
                else:
                    picked = (b, ["query", "question"]) if b else (q, ["query"])
            else:
                picked = (s, ["question"])
            if picked[0]:
                expected[t] = (picked[0][:10], picked[1])
        found = {r.t: (r.units, r.guides) for r in L.select_units(df, "t", "u", "text", question, query).collect()}
        assert found == expected, (query, question)
        guides |= {tuple(g) for _, g in found.values()}
    assert guides == {("query",), ("question",), ("query", "question")}


def test_question_terms():
    assert L.question_terms("What is the port of orders-db in services.yaml? T-0447 rateCeilingKbps, v2 the 7 a") == (["port", "orders", "db", "0447", "rateceilingkbps", "v2", "7"], ["orders-db", "t-0447", "rateceilingkbps"])
    assert L.question_terms("services services.yaml") == (["services"], []) and L.question_terms(None) == ([], [])


def test_room_is_shared(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, 0, 5, 40, 300])) for k in range(30) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "k int, i int, tokens long")
    for room, frame in ((0, 0), (100, 0), (100, 9), (1000, 3), (7, 1)):
        found = {(r.k, r.i): r.granted for r in L.shared_room(df, ["k"], ["i"], room, frame=frame).collect()}
        for k in range(30):
            sizes = [(i, n or 0) for g, i, n in rows if g == k]
            left = max(0, room - frame * len(sizes))
            for at, (i, n) in enumerate(sizes):
                got = min(n, left // (len(sizes) - at))
                assert found[k, i] == got
                left -= got
            assert left >= 0
    assert L.shared_room(df.where(F.lit(False)), ["k"], ["i"], 5).collect() == []
