import random
import re
from itertools import permutations

from convlake.llm import filter_audit
from tests.llm.brute import SPACES

DOCS = "doc_id long, text string, lang string, fails string, good string, sha string, part long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    smallest: dict = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    parts: dict = {}
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in SPACES.split(text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > smallest[text],
        }
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                here = [d for d in docs if name in d[0] and not d[0] & set(order[:step])]
                shapley[name] += len(here)
                kept = sum(not d[0] & set(order[: step + 1]) for d in docs)
                failing = sum(name in d[0] for d in docs)
                out[part, "".join(order), step + 1] = [kept, len(here), failing - len(here), sum(d[0] == {name} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                out[part, "".join(order), step + 1].append(shapley[name])
    return out


def audited(spark, rows, labels, **kw):
    docs = spark.createDataFrame([(i, t, lang, "x", "y", "z", 5) for i, t, lang in rows], DOCS)
    found = filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS), **kw).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}


def test_unions_and_differences():
    rng = random.Random(4)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        a, b = (sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(2))
        assert filter_audit.difference(a, b) == sorted(set(a) - set(b))
        bound, at = rng.randint(0, 61), rng.randint(0, len(a))
        assert filter_audit.gallop(a, at, bound) == next((i for i in range(at, len(a)) if a[i] >= bound), len(a))


def test_audit_against_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "A", "a b # c", "X" * 4 + " y" * 300, " ".join(f"w{i}" for i in range(250)), "one two | " * 120, " ".join(f"w{i}" for i in range(199)), "\x0bé\x1c " * 210, "a b " * 200]
    rows = [(i, rng.choice(texts) if rng.random() < 0.7 else " ".join(rng.choice("ab Cd | e f g".split()) + str(rng.randint(0, 200)) for _ in range(rng.choice([10, 220]))), rng.choice([None, "", "en", "fr", "xx"])) for i in range(120)]
    rows += [(7, rows[7][1], "en"), (7, "other", "en"), (None, "", "en"), (None, None, None), (-5, "A", "fr"), (500, "z " * 200_000 + "Q", "fr"), (501, "z " * 200_000 + "Q", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    expected = brute(rows, labels)
    for range_docs in (3, 1 << 16):
        assert audited(spark, rows, labels, range_docs=range_docs) == expected
    assert audited(spark, rows, []) == brute(rows, [])
    assert audited(spark, [], labels) == {}


def test_posting_lists_are_sorted_and_bounded(spark):
    docs = spark.createDataFrame([(i, "a b", "en" if i % 3 else "fr") for i in range(100)], "doc_id long, text string, lang string")
    lists = filter_audit.posting_lists(filter_audit.flagged(docs, spark.createDataFrame([], LABELS)), range_docs=7).collect()
    assert max(r.docs for r in lists) == 7 and sum(r.docs for r in lists) == 100
    for r in lists:
        assert r.ids == sorted(r.ids) and (r.first_id, r.last_id) == (r.ids[0], r.ids[-1])
        assert [[r.ids[at] for at in fails] for fails in r.fails] == [r.ids, [], [], [], [i for i in r.ids if i]]
