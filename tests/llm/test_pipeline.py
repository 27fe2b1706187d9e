"""Each stage on small documents against a brute-force version, on all that its predecessor kept."""

import random

import corpus_pipeline
from convlake.llm import packing, quality
from convlake.llm.tokens import BpeEncoder, vocabulary
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int"


def documents() -> list[tuple]:
    rng = random.Random(4)
    vocabulary_ = [f"{a}{b}" for a in ("ka", "lo", "mi", "te", "su", "ra") for b in ("n", "r", "st", "ve", "do", "pi")]
    sentence = lambda n: " ".join(rng.choice(vocabulary_) for _ in range(n)).capitalize() + "."
    shared = "This very line stands in a good many of the documents here."
    rows = []
    for i in range(160):
        text = "\n".join(sentence(rng.randrange(6, 20)) for _ in range(rng.randrange(1, 8)))
        if i % 4 == 0:
            text = shared + "\n" + text
        if i % 5 == 4:
            text = " ".join(rng.choice(vocabulary_).upper() + "!!" for _ in range(60))
        elif i % 7 == 6:
            text = rows[5 * rng.randrange(len(rows) // 5)][1] + " more"
        rows.append((i, text))
    rows += [(200, ""), (201, None), (202, rows[0][1]), (203, rows[0][1])]
    return [(i, t, "en", f"src{i % 3}", len(t or ""), 1) for i, t in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(r[0], 0 if r[0] % 5 == 4 else 1, 0) for r in rows if r[0] < 160], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf, names = str(tmp_path), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    model = quality.fit(docs, labels)
    good = stages["quality"](spark, docs, sf)
    expected = [r for r in rows if model.score(r[1]) >= quality.THRESHOLD]
    assert good.columns == docs.columns and sorted(map(tuple, good.collect()), key=str) == sorted(expected, key=str)
    kept = {r[0] for r in expected}
    assert not any(i % 5 == 4 for i in kept if i < 160) and sum(i % 5 != 4 for i in kept) >= 120

    lines = stages["line_dedup"](spark, good, sf)
    want = brute.line_dedup([(r[0], r[1]) for r in expected])
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and got.keys() == want.keys()
    assert all((got[i].text or "") == w[2] and got[i].n_chars == len(w[2]) for i, w in want.items())
    assert any(w[1] for w in want.values())

    one = stages["near_dedup"](spark, lines, sf)
    groups = brute.jaccard_components([(i, r.text) for i, r in got.items()], 5, 80)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert len({c for _, c in groups.values()}) < len(groups)

    final = stages["packing"](spark, one, sf).collect()
    bpe = BpeEncoder(vocabulary("byte_bpe_50k.tiktoken"))
    sizes = {r.doc_id: len(bpe.encode(r.text or "")) + 1 for r in one.collect()}
    assert {i: sum(p.length for p in final if p.doc_id == i) for i in sizes} == sizes
    assert max(p.offset + p.length for p in final) <= packing.SEQUENCE
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {i: sum(p.length for p in whole if p.doc_id == i) for i in sizes} == sizes and {p.doc_id for p in whole} == sizes.keys()
