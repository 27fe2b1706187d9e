import itertools
import random

import pytest

from convlake.llm.ngram_join import ngram_jaccard_join, shingles, signatures
from tests.llm.brute import jaccard_components, shingle_set

SCHEMA = "doc_id long, text string, component string, sig int"


def near_copies(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One "), (6, "one two"), (7, "one two three"), (8, "ONE\ttwo\nthree")]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 15, 40, 120, 600]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(copy)))
            if rng.random() < 0.3:
                base = copy  # chains: ends are linked through the middle only
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "smaller"), [(3, 90, 2), (5, 80, 3)])
def test_same_as_all_pairs(spark, words, percent, smaller):
    rows = near_copies(words)
    got = ngram_jaccard_join(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), words=words, percent=percent, smaller=smaller).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(rows, words, percent)
    assert len(got) == len(rows)


def test_similar_sets_share_a_signature():
    rng = random.Random(5)
    for percent, size in itertools.product((80, 90), (1, 2, 5, 9, 10, 11, 30, 100, 333)):
        for _ in range(20):
            base = {rng.getrandbits(64) for _ in range(size)}
            other = {x for x in base if rng.random() > 0.06} | {rng.getrandbits(64) for _ in range(rng.randrange(1 + size // 20))}
            if 100 * len(base & other) >= percent * len(base | other):
                import numpy as np

                a, b = (signatures(np.array(sorted(s), np.uint64), percent) for s in (base, other))
                assert set(a.tolist()) & set(b.tolist())


def test_shingles_are_those_of_the_contract():
    for text in (None, "", " ", "a", "A b", "a b c", "a  B\tc d", "é É z Z", "x\x00y z w \x1c q", "a" * 9000 + " b c"):
        assert len(shingles(text, 3)) == len(shingle_set(text, 3))


def test_empty_null_and_repeated_ids(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (2, "a b c d e f", "x", 1)]
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(map(str, [(None, None), (1, 1), (1, 1), (2, 1)]))


def test_large_group_of_near_copies_is_whole(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"own{i}", *base[31:]]), "x", 1) for i in range(400)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), words=3, percent=90).collect()
    assert {r.component_id for r in got} == set(range(400)) if jaccard_components([(0, rows[0][1]), (1, rows[1][1])], 3, 90)[1][1] else {0}
