import math
import random

import numpy as np

from convlake.llm.embedding_dedup import _distances, codebook, embedding_dedup, limit_of, slacks, visits
from tests.llm.brute import smallest_reachable

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int"


def brute(rows, cosine=0.98):
    good = {}
    for i, v, label, *_ in rows:
        x = None if v is None or any(e is None for e in v) else np.array(v, np.float32).astype(np.float64)
        if i is not None and label is not None and x is not None and len(x) == 6 and np.isfinite(x).all() and x.any():
            good[i] = (label, x / math.sqrt((x * x).sum()))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and float(good[a][1] @ good[b][1]) >= cosine]
    found = smallest_reachable([r[0] for r in rows if r[0] is not None], links)
    return {i: (sum(i in x for x in links), found[i], found[i] == i) for i in found}


def made(seed, n=300):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = [rng.gauss(0, 1) for _ in range(6)]
        label = rng.choice([0, 0, 0, 1, None])
        for _ in range(rng.randrange(1, 8)):
            rows.append((len(rows), [x + rng.gauss(0, 0.09) for x in base] if rng.random() < 0.8 else base, label, 7))
    bad = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    rows += [(1000 + k, v, 0, 7) for k, v in enumerate(bad)]
    rows.append((2000, [2 * x for x in rows[0][1]], rows[0][2], 7))
    return rows


def test_same_as_all_pairs(spark):
    rows = made(1)
    got = embedding_dedup(spark.createDataFrame(rows, SCHEMA), centroids=8, block=16, recall=1.0).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_group_of_copies_larger_than_a_block(spark):
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in base] if i % 3 else base, 0, 7) for i in range(200)]
    got = embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=16, recall=1.0).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_empty_table_and_null_id(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embedding_dedup(spark.createDataFrame([(None, [1.0] * 6, 0, 1), (3, [1.0] * 6, 0, 1)], SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(None, 0, None, True), (3, 0, 3, True)}


def test_traversal_leaves_out_no_near_vector():
    x = np.random.default_rng(0).normal(size=(400, 8))
    x /= np.sqrt((x**2).sum(1))[:, None]
    books = codebook(x[:, :4], 16), codebook(x[:, 4:], 16)
    d1, d2 = _distances(x[:, :4], books[0]), _distances(x[:, 4:], books[1])
    own = list(zip(d1.argmin(1), d2.argmin(1)))
    s1, s2 = slacks(d1, books[0]), slacks(d2, books[1])
    for i in range(60):
        cells = set(visits(s1[i], s2[i], limit_of(0.875, 1.0, 8)))
        near = np.flatnonzero(((x - x[i]) ** 2).sum(1) <= 0.25)
        assert all(own[j] in cells for j in near)


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(900, 64))
    copies = base[rng.integers(0, 900, 1500)] + rng.normal(size=(1500, 64)) * rng.uniform(0.05, 0.22, 1500)[:, None]
    x = np.concatenate([base, copies]).astype(np.float32)
    label = rng.integers(0, 3, len(x))
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup(rows, centroids=24).collect()}
    x = x.astype(np.float64)
    x /= np.sqrt((x**2).sum(1))[:, None]
    links = ((x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)).sum(1)
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() and links.sum() > 500


def test_widths_tiny_components_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0, 0.0, 0.0], "a"), (5, [1.0, 2.0, 0.0, 0.01], "a"), (6, [5.0, 0.0, 0.0, 1.0], "a"), (7, [1e-200, 2e-200, 0.0, 0.0], "a"), (8, [1e200, 2e200, 0.0, 0.0], "a"), (9, [2.0, 4.0], "a"), (9, [2.0, 4.0], "a")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 3, 4, True), (5, 3, 4, False), (6, 0, 6, True), (7, 3, 4, False), (8, 3, 4, False), (9, 3, 1, False), (9, 3, 1, False)]
