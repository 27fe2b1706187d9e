"""Language identification by cross-parsing: how few pieces of each language's own text does a text need?

For each language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed greedily against each of them:
a phrase is the longest match from where the last one ended, so following the automaton's transitions until there is none yields its length. The
number of phrases times log2 of the sample's length, over the text's length, estimates the cross entropy; the smallest wins.

Texts are parsed in windows, many at once: an automaton is one table of (state, class of character), completed so that a missing
transition leads, marked, to where the next phrase is after its first character. So each character costs one look-up a language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of each language's sample, taken from at most about SAMPLE_ROWS rows (chosen by a hash of the id), so many from each.
SAMPLE_CHARS, SAMPLE_ROWS = 1 << 16, 256
#: Languages learned, the ones with the most rows, and characters of all samples: a state has about 0.4 kB, and there are at most two for each.
MOST_LANGUAGES, ALL_CHARS = 64, 1 << 18
#: Classes of characters beside the one of all that is no letter: the sample's most frequent letters, and shared ones for all other letters.
LETTERS, SHARED = 88, 8
#: Characters of a window; a phrase ends at its end. Windows parsed together.
WINDOW, LANES = 1024, 4096
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double"
_MISS = np.int32(-(1 << 31))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def class_table(texts: list[str]) -> tuple[np.ndarray, int]:
    """The class of every code point: 0 for all that is no letter, then the letters of texts by frequency (without case), then shared ones.
    The second value is the number of classes."""
    seen: dict[str, int] = {}
    for text in texts:
        for c in text.lower():
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    own = {c: 1 + i for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS])}
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            low = low if len(low) == 1 else low[0]
            table[point] = own.get(low) or 1 + len(own) + ord(low) % SHARED
    return table, 1 + len(own) + SHARED


def classes(text: str, table: np.ndarray) -> np.ndarray:
    """The classes of a text's characters (composed, as samples are), a run of non-letters being one 0."""
    points = np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = table[points]
    if len(found):
        found = found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]
    return found


def suffix_automaton(items: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of items (numbers below width), state 0 the start, -1 where there is none."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in items.tolist():
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    table = np.full((len(nexts), width), -1, np.int32)
    for state, out in enumerate(nexts):
        for c, to in out.items():
            table[state, c] = to
    return table


def parser_table(samples: list[np.ndarray], width: int) -> np.ndarray:
    """The completed table of a language, flat, states multiplied by its row length; no match crosses from one sample text to the next.

    The last row is for phrases that have not begun, its last column for the padding behind a window, which begins no phrase. A set sign
    bit says that a phrase begins with this character.
    """
    items = np.concatenate([np.append(s.astype(np.int64), width) for s in samples]) if samples else np.zeros(0, np.int64)
    moves = suffix_automaton(items, width + 1)[:, :width]
    states, row = len(moves), width + 1
    begun = np.where(moves[0] >= 0, moves[0], states) * row
    full = np.full((states + 1, row), 0, np.int32)
    full[:states, :width] = np.where(moves >= 0, moves * row, begun[None, :] | _MISS)
    full[states, :width] = begun | _MISS
    full[:, width] = states * row
    return full.ravel()


def phrases(windows: np.ndarray, table: np.ndarray, row: int) -> np.ndarray:
    """Phrases of each window; windows is (place, lane), padded with row - 1."""
    state = np.full(windows.shape[1], len(table) - row, np.int32)
    count, at = np.zeros(windows.shape[1], np.int64), np.empty_like(state)
    for column in windows:
        np.add(state, column, out=at)
        np.take(table, at, out=state, mode="clip")
        count += state < 0
        np.bitwise_and(state, ~_MISS, out=state)
    return count


class LanguageModel:
    """languages, each one's completed automaton, log2 of its sample's length, the class of every code point and the number of classes."""

    def __init__(self, languages: list[str], tables: list[np.ndarray], bits: list[float], points: np.ndarray, width: int):
        self.languages, self.tables, self.bits, self.points, self.width = languages, tables, bits, points, width

    @classmethod
    def of(cls, samples: dict[str, list[str]]) -> LanguageModel:
        languages = sorted(samples)
        points, width = class_table([t for lang in languages for t in samples[lang]])
        coded = [[classes(t, points) for t in samples[lang]] for lang in languages]
        return cls(languages, [parser_table(c, width) for c in coded], [float(np.log2(2 + sum(map(len, c)))) for c in coded], points, width)

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases by language and text."""
        row = self.width + 1
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // WINDOW) for t in texts])
        cuts = [t[at : at + WINDOW] for t in texts for at in range(0, len(t), WINDOW)]
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        by_length = np.argsort([-len(c) for c in cuts], kind="stable")
        for at in range(0, len(cuts), LANES):
            some = by_length[at : at + LANES]
            lanes = np.full((len(some), len(cuts[some[0]])), row - 1, np.uint8)
            for i, c in enumerate(some):
                lanes[i, : len(cuts[c])] = cuts[c]
            windows = np.ascontiguousarray(lanes.T)
            for k, table in enumerate(self.tables):
                np.add.at(total[k], owner[some], phrases(windows, table, row))
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """A language and how sure it is (0 to 1) for each text."""
        coded = [classes(t or "", self.points) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts = self.counts(coded)
        out = []
        for i, c in enumerate(coded):
            if not c.any():
                out.append((UNKNOWN, 0.0))
                continue
            entropy = counts[:, i] * np.array(self.bits) / len(c)
            best = int(np.argmin(entropy))
            out.append((self.languages[best], float(1 / np.exp2((entropy[best] - entropy) * np.sqrt(len(c))).sum())))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """A model of the rows that are not held out. Of each language about sample_rows rows, chosen by a hash, give at most their share of
    sample_chars characters, from a place chosen by the same hash."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("id")
    )
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()  # MOST_LANGUAGES rows
    if not rows:
        return LanguageModel([], [], [], np.zeros(0x110000, np.uint8), 1)
    share = max(1, min(sample_chars, ALL_CHARS // len(rows)) // sample_rows)
    part = F.create_map(*(F.lit(x) for r in rows for x in (r.lang, int(min(1.0, sample_rows / r["count"]) * (1 << 30)))))
    at = F.xxhash64(F.lit(11), "id", F.length("text"))
    chosen = known.where(F.pmod(at, F.lit(1 << 30)) < F.element_at(part, F.col("lang")))
    chosen = chosen.select("lang", "id", F.substring("text", F.pmod(F.shiftright(at, 31), F.greatest(F.length("text") - share, F.lit(0)) + 1).cast("int") + 1, F.lit(share)).alias("text"))
    samples: dict[str, list[str]] = {r.lang: [] for r in rows}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.id is None, r.id, r.text)):  # about languages x sample_chars characters
        samples[r.lang].append(r.text)
    return LanguageModel.of(samples)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables, model.bits, model.points, model.width))  # bounded by ALL_CHARS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = LanguageModel(*shared.value)
        for batch in batches:
            found = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    lang is read of rows to learn from only; ids, sources and languages are never inputs of a prediction. A text that is null or has no letter
    is `und` with score 0, as is every text where no language can be learned. Ties go to the first language by name. A row without id is
    predicted, too, and held out as an empty id would be; repeated rows are predicted each. Other columns are not read. An empty table gives
    no rows.
    """
    found = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
