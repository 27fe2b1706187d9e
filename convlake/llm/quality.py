"""Quality classifier: naive Bayes support vector machine over n-gram indicators.

A text's n-grams are those of its shape (runs of letters, digits and white space count once, every other character stands for itself), of
its words, and of which words repeat the one before or two before. An indicator is scaled by the log ratio of its share among the good
texts to that among the bad; a linear model with hinge loss is fitted to the scaled, length-normalised indicators by dual coordinate
descent, and its margins are turned into probabilities by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.llm.common import discard, store
from convlake.llm.ngram_join import _mix

#: Indicators (a power of two); n-grams are hashed into them.
DIMENSIONS = 1 << 18
#: Labelled rows that the model is fitted on, at most about; chosen by a hash of the id.
SAMPLE = 6_000
#: Indicators of all those rows together, at most: 4 bytes each at the driver. Rows beyond that, in the order of the same hash, are left out.
MOST_INDICATORS = 50_000_000
SHAPE_GRAMS, REPEAT_GRAMS = (1, 2, 3, 4, 5), (1, 2, 3, 4)
ALPHA, COST, ROUNDS = 1.0, 1.0, 12
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint64) + np.uint64(16)
_SHAPE[128:] = _SHAPE[97:123] = 1
_SHAPE[65:91], _SHAPE[48:58], _SHAPE[[9, 10, 11, 12, 13]], _SHAPE[32] = 2, 3, 4, 5
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(items: np.ndarray, n: int, kind: int) -> np.ndarray:
    count = max(0, len(items) - n + 1)
    total = np.full(count, np.uint64(kind * 16 + n))
    for i in range(n):
        total = total * _BASE + items[i : i + count]
    return _mix(total) & np.uint64(DIMENSIONS - 1)


def indicators(text: str | None) -> np.ndarray:
    """The sorted indices of a text's indicators. Index 0 is the one that every text has."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    flags = np.zeros(DIMENSIONS, bool)
    flags[0] = True
    if len(raw):
        shape = _SHAPE[raw]
        first = np.ones(len(shape), bool)
        first[1:] = (shape[1:] != shape[:-1]) | (shape[1:] > 5)
        shape = shape[first]
        for n in SHAPE_GRAMS:
            flags[_grams(shape, n, 1)] = True
        solid = (raw > 32) | ((raw < 9) | ((raw > 13) & (raw < 32)))
        starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        if len(starts):
            base = np.zeros(len(raw), np.int64)
            base[starts] = starts
            at = (np.arange(len(raw)) - np.maximum.accumulate(base)).astype(np.uint64)
            word = np.add.reduceat(_mix(_BYTE[raw] + at * _BASE) * solid, starts)
            flags[_grams(word, 1, 2)] = True
            again = np.zeros(len(word), np.uint64)
            again[2:][word[2:] == word[:-2]] = 1
            again[1:][word[1:] == word[:-1]] = 2
            for n in REPEAT_GRAMS:
                flags[_grams(again, n, 3)] = True
    return np.flatnonzero(flags).astype(np.int32)


class QualityModel:
    """bias and weights of the indicators (the log-count ratios are multiplied in), and the logistic curve over margins."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def margin(self, active: np.ndarray) -> float:
        return float(self.weights[active].sum(dtype=np.float64) / np.sqrt(len(active)))

    def shared(self, spark: SparkSession):
        """A broadcast of plain numbers (DIMENSIONS of them), which workers can read without this package."""
        return spark.sparkContext.broadcast((self.weights, self.slope, self.offset))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.offset, -60, 60))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    p, q = np.full(DIMENSIONS, ALPHA), np.full(DIMENSIONS, ALPHA)
    for active, y in zip(rows, good):
        (p if y else q)[active] += 1
    return np.log(p / (good.sum() + 2 * ALPHA)) - np.log(q / ((~good).sum() + 2 * ALPHA))


def dual_coordinate_descent(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """min 1/2 |w|^2 + sum of cost x hinge loss, over rows of ratios at the active indicators, divided by the root of their number.

    Both classes weigh the same in total. Returns w times the ratios: what an active indicator adds to the margin.
    """
    y = np.where(good, 1.0, -1.0)
    values = [ratios[a] / np.sqrt(len(a)) for a in rows]
    square = np.array([max(1e-12, float(v @ v)) for v in values])
    most = np.where(good, cost * len(good) / (2 * max(1, good.sum())), cost * len(good) / (2 * max(1, (~good).sum())))
    w, alpha, rng = np.zeros(len(ratios)), np.zeros(len(rows)), np.random.default_rng(3)
    for _ in range(rounds):
        change = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                change = max(change, abs(new - alpha[i]))
                alpha[i] = new
        if change < 1e-3:
            break
    return w * ratios


def logistic_curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to probabilities of a good text, by Newton steps on smoothed targets."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * theta)
        theta = theta + step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def fit_rows(rows: list[np.ndarray], good: np.ndarray) -> QualityModel:
    """Margins for the logistic curve come from models that have not seen the row (two folds)."""
    if not good.any() or good.all():
        return QualityModel(np.zeros(DIMENSIONS, np.float32), 1.0, float(np.log((good.sum() + 1) / ((~good).sum() + 1))))
    fold, margins = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for f in (0, 1):
        seen = fold != f
        if good[seen].any() and not good[seen].all():
            own = [rows[i] for i in np.flatnonzero(seen)]
            weights = dual_coordinate_descent(own, good[seen], log_count_ratios(own, good[seen]))
            for i in np.flatnonzero(~seen):
                margins[i] = weights[rows[i]].sum() / np.sqrt(len(rows[i]))
    weights = dual_coordinate_descent(rows, good, log_count_ratios(rows, good))
    return QualityModel(weights.astype(np.float32), *logistic_curve(margins, good))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most_indicators: int = MOST_INDICATORS) -> QualityModel:
    """A model of labels (id, 0 or 1) of rows that are not held out, over at most about `sample` of them and `most_indicators` indicators.

    The rows are chosen by a hash of their id, so the broadcast side is bounded by `sample`. Rows without label or text, and ids with two
    different labels, are not learnt from; of rows that share an id one is, the one with the least text.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("fit_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    total = known.count()
    part = int(min(1.0, sample / max(1, total)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(8), "fit_id"), F.lit(1 << 30)) < part).select("fit_id", F.col("y").cast("int").alias("y"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                active = indicators(batch.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([active.tobytes()], pa.binary())], names=["fit_id", "y", "active"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("fit_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "fit_id").groupBy("fit_id", "y").agg(F.min("text").alias("text"))
    read_rows = store(rows.mapInArrow(read, "fit_id long, y int, active binary"), "quality-rows")
    sized = read_rows.select("fit_id", (F.length("active") / 4).alias("n"), F.xxhash64(F.lit(8), "fit_id").alias("h"))  # `sample` rows at most
    running = F.sum("n").over(Window.orderBy(F.pmod("h", F.lit(1 << 30)), "fit_id"))
    few = sized.select("fit_id", running.alias("running")).where(F.col("running") <= most_indicators).select("fit_id")
    table = read_rows.join(F.broadcast(few), "fit_id").toArrow().sort_by("fit_id")
    discard(read_rows)
    active = [np.frombuffer(x.as_py(), np.int32) for x in table.column("active")]
    return fit_rows(active, table.column("y").to_numpy() == 1)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, 0 to 1, of every row; null text counts as empty."""
    shared = model.shared(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = QualityModel(*shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    shared = model.shared(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = QualityModel(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Ids, labels, languages and sources are never inputs of a score. Null text counts as empty and gets the score of an empty text; a row
    without id is scored, and its held_out is that of an empty id. Where no row is labelled, or all have one label, every score is the
    smoothed share of good rows. An empty table gives an empty result. Other columns are not read.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col, sample), id_col, text_col)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
