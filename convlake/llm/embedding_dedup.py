"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in halves; each half has its own codebook, and the pairs of centroids form a grid of cells. A vector is filed in the
cell of its nearest centroids. A query walks the cells in the order of its distance from them (multi-sequence traversal of the two sorted
lists of centroids) and stops when what is left can hold less than the missing part of the target recall. What lies in the visited cells
is compared in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import store
from convlake.llm.components import components

COSINE, RECALL = 0.98, 0.999
#: Vectors that the codebooks are fitted on, at most about. Every vector is filed and asked, whatever this bound is.
SAMPLE = 16_384
#: Vectors of one cell that a task compares at a time with as many others.
BLOCK = 1_024
#: Centroids of a codebook at most. Their number grows with the root of the vectors, so that a cell holds about PER_CELL of them.
CENTROIDS, PER_CELL = 2_048, 64


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (x**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * x @ centroids.T
    return np.sqrt(np.maximum(d, 0))


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means of the rows of x, from rows spread over x; the same rows give the same centroids."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x if len(x) else np.zeros((1, x.shape[1]))
    centroids = x[np.random.default_rng(1).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def slacks(distances: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each query how far it is from the region of each centroid: from the plane that parts it from the query's own centroid."""
    rows, near = np.arange(len(distances)), distances.argmin(1)
    apart = np.maximum(_distances(book, book)[near], 1e-12)
    s = np.maximum((distances**2 - (distances[rows, near] ** 2)[:, None]) / (2 * apart), 0)
    s[rows, near] = 0
    return s


def limit_of(cosine: float, recall: float, width: int) -> float:
    """The squared slack up to which cells are visited.

    A vector within reach of a query can be in a cell only if the squares of the two slacks sum up to reach^2 at most: that is the limit for
    a recall of 1. A displacement of that length in any direction has a component of variance reach^2 / width along each of the two planes'
    normals, so the sum exceeds -2 ln(1 - recall) reach^2 / width in no more than 1 - recall of all directions.
    """
    reach = max(0.0, 2 - 2 * cosine)
    return reach if recall >= 1 else min(reach, -2 * math.log(1 - recall) * reach / width)


def visits(s1: np.ndarray, s2: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The cells a query visits, nearest first; s1, s2: its slacks in either half."""
    o1, o2 = np.argsort(s1, kind="stable").tolist(), np.argsort(s2, kind="stable").tolist()
    a, b = (s1[o1] ** 2).tolist(), (s2[o2] ** 2).tolist()
    cells, queue, met = [], [(0.0, 0, 0)], {(0, 0)}
    while queue and queue[0][0] <= limit + 1e-9:
        _, i, j = heapq.heappop(queue)
        cells.append((o1[i], o2[j]))
        for n, m in ((i + 1, j), (i, j + 1)):
            if n < len(a) and m < len(b) and (n, m) not in met:
                met.add((n, m))
                heapq.heappush(queue, (a[n] + b[m], n, m))
    return cells


def _unit(vectors: list, width: int) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(len(vectors), width)
    x = x / np.abs(x).max(1, initial=0)[:, None]  # squares of very small or large numbers stay what they are
    return x / np.sqrt((x**2).sum(1))[:, None]


def _filer(books: tuple[np.ndarray, np.ndarray], width: int, limit: float):
    """(rep, vector) to a row for its own cell (side 0) and one for each cell that it visits (side 1)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                one, two = (_distances(h, b) for h, b in zip(_halves(_unit(part["vector"].tolist(), width)), books))
                s1, s2 = slacks(one, books[0]), slacks(two, books[1])
                rows = [(i, 0, int(c1), int(c2)) for i, (c1, c2) in enumerate(zip(one.argmin(1), two.argmin(1)))]
                for i in range(len(part)):
                    rows += [(i, 1, *cell) for cell in visits(s1[i], s2[i], limit)]
                i, side, c1, c2 = np.array(rows).T
                yield pd.DataFrame({"rep": part["rep"].to_numpy()[i], "side": side, "c1": c1, "c2": c2})

    return run


def _compare(width: int, cosine: float):
    """All vectors of a block of a cell against a block of those that visit it: links of each visitor, and links enough to join all that are linked."""

    def run(filed, visiting):
        import pandas as pd

        none = pd.DataFrame({"rep": [], "found": [], "other": []}).astype("int64")
        if not len(filed) or not len(visiting):
            return none
        near = _unit(visiting["vector"].tolist(), width) @ _unit(filed["vector"].tolist(), width).T >= cosine
        q, y = visiting["rep"].to_numpy(), filed["rep"].to_numpy()
        near &= q[:, None] != y[None, :]
        found = near @ filed["copies"].to_numpy().astype(np.float64)
        most = np.iinfo(np.int64).max
        least_y, least_q = y.copy(), q.copy()
        while True:  # the smallest id that each can reach inside these blocks
            new_q = np.minimum(least_q, np.where(near, least_y[None, :], most).min(1))
            new_y = np.minimum(least_y, np.where(near, new_q[:, None], most).min(0))
            if (new_q == least_q).all() and (new_y == least_y).all():
                break
            least_q, least_y = new_q, new_y
        some = near.any(0)
        return pd.DataFrame(
            {
                "rep": np.concatenate([q, y[some]]),
                "found": np.concatenate([found.astype(np.int64), np.zeros(some.sum(), np.int64)]),
                "other": np.concatenate([least_q, least_y[some]]),
            }
        ).query("found > 0 or other != rep")

    return run


def _linked(usable: DataFrame, width: int, cosine: float, recall: float, sample: int, centroids: int | None, block: int) -> DataFrame:
    """(label, vector, n_links, component_id) of each different vector of one width."""
    classes = store(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")

    n = classes.count()
    part = min(1.0, sample / n)
    fit = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(part * (1 << 30))).orderBy("rep").select("vector").toPandas()
    if not len(fit):
        fit = classes.limit(1).select("vector").toPandas()
    k = centroids or int(min(CENTROIDS, max(4, 2 ** round(np.log2(max(1, n / PER_CELL)) / 2))))
    books = tuple(codebook(h, k) for h in _halves(_unit(fit["vector"].tolist(), width)))
    cells = classes.select("rep", "vector").mapInPandas(_filer(books, width, limit_of(cosine, recall, width)), "rep long, side int, c1 int, c2 int")
    filed = store(cells.join(classes, "rep").select("label", "c1", "c2", "side", "rep", "copies", "vector"), "filed-vectors")
    cell = ["label", "c1", "c2"]
    blocks = filed.groupBy(*cell, "side").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = store(blocks.groupBy(*cell).agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("blocks"))), F.lit(0)).alias(f"blocks{s}") for s in (0, 1))).where("blocks0 > 0 AND blocks1 > 0"), "cell-sizes")
    dealt = filed.join(sizes, cell)
    mine = lambda s: F.pmod(F.xxhash64("rep"), F.col(f"blocks{s}")).cast("int")
    left = dealt.where("side = 0").select(*cell, mine(0).alias("b0"), F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1)).alias("b1"), "rep", "copies", "vector")
    right = dealt.where("side = 1").select(*cell, F.explode(F.sequence(F.lit(0), F.col("blocks0") - 1)).alias("b0"), mine(1).alias("b1"), "rep", "vector")
    key = [*cell, "b0", "b1"]
    right = right.toDF(*(f"{c}_asking" for c in right.columns))
    compare = _compare(width, cosine)
    met = left.groupBy(*key).cogroup(right.groupBy(*(f"{c}_asking" for c in key))).applyInPandas(lambda a, b: compare(a, b.rename(columns=lambda c: c.removesuffix("_asking"))), "rep long, found long, other long")
    met = store(met.groupBy("rep", "other").agg(F.sum("found").alias("found")), "vector-links")

    counts = met.groupBy("rep").agg(F.sum("found").alias("found"))
    joined = components(met.where("rep <> other"), "rep", "other").withColumnRenamed("id", "rep")
    return classes.join(counts, "rep", "left").join(joined, "rep", "left").select(
        "label", "vector", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, centroids: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (others linked directly), component_id (smallest id that links reach), kept.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least `cosine`. Equal vectors are
    compared once, as one with a count. Vectors of different widths do not link; each width has its own codebooks. A vector that is null,
    empty or all zero, or holds a null or non-finite number, links with nothing; it is kept, as is a row without id (its component is null). Rows that share an id, label and
    vector are copies of each other. An empty table gives an empty result. Only the three named columns are read.

    The codebooks are fitted on about `sample` vectors (a bound), chosen by hash; every vector is filed and every vector is asked. Each
    vector finds its links with at least the target recall (1: all of them); the tests measure it against all pairs. Cells are compared in blocks of about `block` rows, so a cell with any number of near copies is
    spread over many tasks, and only counts and links that span a block's components leave a task.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    good = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("vector", lambda v: v != 0)
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    widths = [r.w for r in usable.groupBy(F.size("vector").alias("w")).count().orderBy("w").collect()]
    if not widths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = [_linked(usable.where(F.size("vector") == w), w, cosine, recall, sample, centroids, block) for w in widths]
    known = reduce(DataFrame.unionByName, known)
    out = rows.alias("r").join(known.alias("k"), (F.col("r.label") == F.col("k.label")) & (F.col("r.vector") == F.col("k.vector")) & F.col("r.vec_id").isNotNull(), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
