import random
import zlib

import numpy as np

from convlake.llm import language_id as lid


def phrases(text: list[int], samples: list[list[int]]) -> int:
    """Longest matches one after the other, by looking for each in the samples."""
    held = ["".join(map(chr, s)) for s in samples]
    n = at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and any("".join(map(chr, text[at : to + 1])) in h for h in held):
            to += 1
        n, at = n + 1, to
    return n


def test_parsing_against_substring_search():
    rng = random.Random(5)
    for width in (2, 4):
        for _ in range(20):
            samples = [[rng.randrange(width) for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(0, 3))]
            table = lid.parser_table([np.array(s, np.uint8) for s in samples], width + 1)
            texts = [[rng.randrange(width + 1) for _ in range(rng.randint(0, 50))] for _ in range(8)]
            lanes = np.full((50, 8), width + 1, np.uint8)
            for k, t in enumerate(texts):
                lanes[: len(t), k] = t
            assert lid.phrases(lanes, table, width + 2).tolist() == [phrases(t, samples) for t in texts]


def test_windows_add_up(monkeypatch):
    monkeypatch.setattr(lid, "WINDOW", 16)
    monkeypatch.setattr(lid, "LANES", 3)
    model = lid.LanguageModel.of({"a": ["the cat sat on the mat"], "b": ["le chat est sur la table"]})
    texts = ["the cat sat on the table and the mat is on the cat", "", "le chat" * 9, "x" * 100]
    counts = model.counts([lid.classes(t, model.points) for t in texts])
    for k, sample in enumerate(["the cat sat on the mat", "le chat est sur la table"]):
        for i, t in enumerate(texts):
            c = lid.classes(t, model.points).tolist()
            assert counts[k, i] == sum(phrases(c[at : at + 16], [lid.classes(sample, model.points).tolist()]) for at in range(0, len(c), 16))


def test_defined_results(spark):
    learn = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the house and the tree with the dog", "en"), ("das haus und der baum mit dem hund", "de")] * 40)]
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "12 -- !!\n", None, "s"), (903, "the dog " * 50_000, None, "s"), (904, "DER HUND UND DAS HAUS", None, "s"), (905, "Жизнь", None, "s"), (906, "é\U0001f600a", None, "s"), (None, "the tree", None, "s"), (904, "the tree", None, "s")]
    docs = spark.createDataFrame(learn + odd, "doc_id long, text string, lang string, lang_pred string")
    rows = lid.language_id(docs).collect()
    assert len(rows) == len(learn) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in rows)
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add((r.lang_pred, r.score if r.lang_pred == "und" else None))
    assert found[900] == found[901] == found[902] == {("und", 0.0)}
    assert found[903] == {("en", None)} and found[904] == {("de", None), ("en", None)} and found[None] == {("en", None)}
    assert found[905] <= {("de", None), ("en", None)} and found[906] <= {("de", None), ("en", None)}
    none = lid.language_id(docs.withColumn("lang", docs.lang.substr(1, 0)).where("lang is null")).collect()
    assert none and all((r.lang_pred, r.score) == ("und", 0.0) for r in none)
    assert lid.language_id(docs.limit(0)).collect() == []


def test_only_rows_that_are_not_held_out_are_learnt(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "abc def", "zz") for i in ids] + [(i, "abc def", "en") for i in range(400) if i not in ids], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lid.language_id(docs).select("lang_pred").distinct().collect()} == {"en"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found) > 100
