import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convlake.llm import phrases
from tests.llm.brute import lower_ascii

DOCS = "doc_id long, text string, lang string, gram string, n long, path long"


def brute(rows, min_count=30, top=2000, scale=2_000_000):
    counts: dict = {}
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= min_count]
        held: Counter = Counter()
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], f[p])
        best = []
        for p in found:
            if 100 * held[p] >= 80 * f[p]:
                continue
            score, _, left, right = min((scale * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -f[p], " ".join(p).encode(), left, right))
        n = sum(a for p, a in f.items() if len(p) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n, -score)
    return out


def mined(spark, rows, **kw):
    docs = spark.createDataFrame([(1, t, lang, "x", 2, 3) for t, lang in rows], DOCS)
    found = phrases.collocations(docs, **kw)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()}


def test_against_brute_force(spark):
    rng = random.Random(6)
    passages = [" ".join(f"{p}{i}" for i in range(n)) for p, n in (("x", 5), ("y", 40), ("Z", 3), ("é", 9))]
    rows = []
    for _ in range(300):
        bits = [rng.choice(passages) if rng.random() < 0.3 else " ".join(rng.choice("a b c d e dé 日 %").strip() or "q" for _ in range(rng.randint(0, 9))) for _ in range(6)]
        rows.append((rng.choice([". ", ", ", "\n", " ", "\t", "!?"]).join(bits), rng.choice(["en", "fr", None, "und", ""])))
    rows += [(None, "en"), ("", "fr"), (" ,\r\x0b", "xx"), ("aa " * 500, "rep"), ("aa bb " * 300, "rep"), ("Aa\tBB  aa", "rep")]
    for kw in ({"min_count": 5}, {"min_count": 2, "top": 7, "block_words": 50, "bucket_bytes": 2_000}):
        assert mined(spark, rows, **kw) == brute(rows, **{k: v for k, v in kw.items() if k in ("min_count", "top")})
    assert mined(spark, []) == {} and mined(spark, [("a b c", "en")]) == {}


def test_long_pieces_are_counted_whole(spark):
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    assert mined(spark, [(text, "en"), ("one " + "x" * 1_000_000, "en")]) == brute([(text, "en"), ("one " + "x" * 1_000_000, "en")])


@pytest.mark.parametrize("read_bytes", [1, 2, 5, 1000])
def test_blocks(monkeypatch, read_bytes):
    monkeypatch.setattr(phrases, "READ_BYTES", read_bytes)
    rng = random.Random(read_bytes)
    for _ in range(30):
        block, expected = phrases.Block(), {4: Counter(), 2: Counter(), 1: Counter()}
        for _ in range(rng.randint(1, 4)):
            text = "".join(rng.choice(["a", "B", "é", "cc", " ", " ", "\t", ".", "\n", " ", "a b c a b "]) for _ in range(rng.randint(0, 30)))
            block.add(text)
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text)):
                w = re.findall(r"[^\x20\x09]+", piece)
                expected[4].update(" ".join(w[i : i + 4]) for i in range(len(w) - 3))
                expected[4].update([" ".join(w[-3:]) + " "] if len(w) > 2 else [])
                expected[2].update(" ".join(w[i : i + 2]) for i in range(len(w) - 1))
                expected[1].update(w)
        found = {4: Counter(), 2: Counter(), 1: Counter()}
        places = {}
        for lang, bucket, size, once, often, counts in block.packed("en", 3):
            found[size].update(x.decode() for x in phrases._grams(once))
            found[size].update({x.decode(): n for x, n in zip(phrases._grams(often), counts, strict=True)})
            for x in phrases._grams(once) + phrases._grams(often):
                assert places.setdefault((size, x.rsplit(b" ", 1)[0] if size == 4 else x), bucket) == bucket and lang == "en"
        assert found == expected


def test_buckets_are_counted_in_arrays(monkeypatch):
    rng = random.Random(3)
    batches, expected, size = [], {4: Counter(), 2: Counter(), 1: Counter()}, 0
    for _ in range(8):
        block = phrases.Block()
        block.add(". ".join(" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 40))) for _ in range(1500)))
        rows = list(block.packed("en", 1))
        for _, _, k, once, often, counts in rows:
            expected[k].update(phrases._grams(once) + [g for g, n in zip(phrases._grams(often), counts) for _ in range(n)])
            size += len(once) + len(often)
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        batches += [pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[f.split()[0] for f in phrases.PACKED.split(", ")]) for row in rows]
    through: Counter = Counter()
    for edge, n in expected[4].items():
        through[edge.rsplit(b" ", 1)[0]] += n
    wanted = {(4, e.decode(), n, through[e.rsplit(b" ", 1)[0]]) for e, n in expected[4].items() if n > 2 and not e.endswith(b" ")}
    wanted |= {(k, g.decode(), n, None) for k, grams in ((3, through), (2, expected[2]), (1, expected[1])) for g, n in grams.items() if n > 2}
    wanted.add((0, "", sum(expected[1].values()), None))
    for merged in (1 << 20, 0):
        monkeypatch.setattr(phrases, "MERGED_GRAMS", merged)
        tracemalloc.start()
        found = list(phrases._count(3)((pa.scalar("en"), pa.scalar(0)), iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {(r["size"], r["gram"], r["n"], r["flow"]) for b in found for r in b.to_pylist()} == wanted and sum(b.num_rows for b in found) == len(wanted)
        assert peak < 2 * size  # dicts of them took 6.8 times their bytes


def test_unary_nodes_become_paths(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(" ".join(words), "en")] * 2 + [(" ".join(words[100:120]), "en"), ("p q w5 w6 w7 w8 z", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    grams = phrases.frequent_grams(docs, min_count=2).cache()
    nodes = grams.where("size = 3").select("lang", F.col("gram").alias("next"), F.col("n").alias("next_flow"))
    edges = grams.where("size = 4").withColumn("next", phrases.last_words("gram", 3)).join(nodes, ["lang", "next"]).select("lang", "gram", "n", "flow", "next_flow")
    paths: dict = {}
    for r in phrases.compact_paths(edges).collect():
        paths.setdefault(r.path, []).append((r.place, r.gram, r.n))
    lengths = sorted((len(p), {n for _, _, n in p}) for p in paths.values())
    assert lengths == [(1, {3}), (5, {2}), (17, {3}), (94, {2}), (2880, {2})]
    for path, held in paths.items():
        held.sort()
        assert held[0][1] == path and [h[0] for h in held] == list(range(len(held)))
        assert all(a[1].split(" ")[1:] == b[1].split(" ")[:3] for a, b in zip(held, held[1:]))
    assert mined(spark, rows, min_count=2) == brute(rows, min_count=2)


def test_scores_are_exact(spark):
    rows = [(4 * 10**18, 4 * 10**18, 4 * 10**18), (999_999_999_999_999_999, 10**18, 10**18), (30, 2**62, 2**62), (10**15 - 1, 10**15, 10**15)]
    found = spark.createDataFrame(rows, "a long, x long, y long").select(phrases._cut(1, F.col("a"), F.col("x"), F.col("y")).alias("c")).collect()
    assert [r.c.score for r in found] == [2_000_000 * a // (x + y) for a, x, y in rows]
