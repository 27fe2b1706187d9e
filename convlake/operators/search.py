"""Full-text search: BM25 over pieces or passages, strict and phrase matches, rank fusion, excerpts.

Only the query's terms leave the rows: their counts are taken inside each row, so a search shuffles a few small rows for each term and
never a posting list, and the text itself moves only for the hits that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import STOP_WORDS, fold, terms, token_groups

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WINDOW, STEP = 700, 550
FUSION_K = 30


def equal_to(word: str):
    return lambda t: t == word


def of_term(word: str):
    return lambda h: h["term"] == word


def query_words(query: str, most: int = 16) -> list[str]:
    """Different words of a query that are longer than one character, without stop words unless nothing else is left."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    found = list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", plain) if len(w) > 1))
    return ([w for w in found if w not in STOP_WORDS] or found)[:most]


def term_counts(pieces: DataFrame, wanted: list[str], content: str = "content", toks: Column | None = None) -> DataFrame:
    """pieces with dl (terms of the text) and hits: an array of (term, f) for the wanted terms that occur."""
    toks = terms(F.col(content)) if toks is None else toks
    counted = F.array(*(F.struct(F.lit(w).alias("term"), F.size(F.filter("toks", equal_to(w))).alias("f")) for w in wanted))
    # exploding one element keeps the optimizer from writing the tokenizer into every use of its result
    cut = pieces.withColumn("toks", F.explode(F.array(toks)))
    return cut.withColumn("dl", F.size("toks")).withColumn("hits", F.explode(F.array(F.filter(counted, lambda h: h["f"] > 0))))


def bm25(pieces: DataFrame, wanted: list[str], content: str = "content", where: Column | None = None, toks: Column | None = None) -> DataFrame:
    """pieces that hold a wanted term, with score and n_terms.

    score is the sum over terms of idf f (k1+1) / (f + k1 (1 - b + b dl / avgdl)), idf at least 1e-6. The number of texts, their mean length and
    the terms' frequencies are those of all pieces; `where` filters the hits afterwards.
    """
    counted = term_counts(pieces, wanted, content, toks)
    stats = counted.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"), *(F.count_if(F.exists("hits", of_term(w))).alias(f"df{i}") for i, w in enumerate(wanted)))
    idf = F.create_map(*(x for i, w in enumerate(wanted) for x in (F.lit(w), F.greatest(F.log((F.col("n_all") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF)))))
    hits = counted.where(F.size("hits") > 0)
    if where is not None:
        hits = hits.where(where)
    hits = hits.crossJoin(F.broadcast(stats.select("avgdl", idf.alias("idf"))))  # one row
    part = lambda h: F.element_at("idf", h["term"]) * h["f"] * (K1 + 1) / (h["f"] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = F.aggregate(F.transform("hits", part), F.lit(0.0), lambda a, x: a + x)
    return hits.withColumn("score", score).withColumn("n_terms", F.size("hits")).drop("toks", "dl", "hits", "avgdl", "idf")


def top(scored: DataFrame, limit: int, *ties: str) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), *ties).limit(limit)


def holds_all(content: Column, groups: list[list[str]]) -> Column:
    """Whether a text holds, of each group, the whole word (the first) or all of its parts (the rest)."""
    found = F.flatten(token_groups(content))
    test = F.lit(True)
    for whole, *parts in groups:
        some = F.array_contains(found, whole)
        if parts:
            some = some | F.forall(F.array(*map(F.lit, parts)), lambda p: F.array_contains(found, p))
        test = test & some
    return test


def holds_phrase(content: Column, phrase: str) -> Column:
    """Whether the phrase's terms follow each other in a text."""
    return F.contains(F.concat(F.lit(" "), F.array_join(terms(content), " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(terms(F.lit(phrase)), " "), F.lit(" ")))


def passages(pieces: DataFrame, content: str = "content", window: int = WINDOW, step: int = STEP) -> DataFrame:
    """Overlapping passages of each piece: off (from 0), len, passage. The last one ends at the text's end."""
    n = F.length(content)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - window) / step).cast("int")))
    rows = pieces.withColumn("part", F.explode(starts)).withColumn("off", F.col("part") * step)
    return rows.withColumn("passage", F.substring(F.col(content), F.col("off") + 1, F.lit(window))).withColumn("len", F.length("passage")).drop("part")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def snapped_windows(pieces: DataFrame, id_col: str = "rid", content: str = "content", window: int = WINDOW, step: int = STEP, near: int = 80) -> DataFrame:
    """Passages that begin and end behind line ends where there are some near: id, off, len. Ids are unique; a null text is an empty one.

    A window ends behind the last line end of its second half. The next one begins `step` later (or where it ended, if that is earlier),
    or behind the first line end of the `near` characters before that place. Places of line ends are running sums over a text's lines; the
    windows are an ordered fold over them.
    """
    lines = pieces.select(id_col, F.posexplode(F.split(F.coalesce(content, F.lit("")), "\n", -1)).alias("pos", "line"))
    behind = F.sum(F.length("line") + 1).over(Window.partitionBy(id_col).orderBy("pos"))
    texts = lines.select(id_col, behind.cast("int").alias("behind")).groupBy(id_col).agg(F.array_sort(F.collect_list("behind")).alias("ends"))
    texts = texts.select(id_col, (F.element_at("ends", -1) - 1).alias("n"), F.slice("ends", F.lit(1), F.size("ends") - 1).alias("ends"))
    among = lambda low, high: F.filter("ends", lambda e: (e > low) & (e <= high))

    def stop(off: Column) -> Column:
        snapped = F.coalesce(F.array_max(among(off + window // 2, off + window)), off + window)
        return F.when(off + window >= F.col("n"), F.col("n")).otherwise(snapped)

    def following(off: Column, end: Column) -> Column:
        plain = F.least(off + step, end)
        return _let(plain, lambda p: _let(F.array_min(among(p - near, p)), lambda e: F.when(e > off + 1, e).otherwise(p)))

    def add(state: Column, _: Column) -> Column:
        windows, off = state["windows"], state["off"]
        grown = _let(stop(off), lambda end: F.struct(F.concat(windows, F.array(F.struct(off.alias("off"), (end - off).alias("len")))).alias("windows"), F.when(end < F.col("n"), following(off, end)).alias("off")))
        return F.when(off.isNull(), state).otherwise(grown)

    start = F.struct(F.array().cast("array<struct<off:int,len:int>>").alias("windows"), F.lit(0).alias("off"))
    turns = F.sequence(F.lit(0), (F.col("n") / (min(window // 2, step) - near)).cast("int") + 1)  # a window moves on by more than that
    return texts.select(id_col, F.inline(F.aggregate(turns, start, add)["windows"]))


def best_per(scored: DataFrame, *keys: str) -> DataFrame:
    """The best passage of each piece."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "off")
    return scored.withColumn("at", F.row_number().over(w)).where("at = 1").drop("at")


def fuse(ranked: DataFrame, key: str = "rid", query: str = "query", order: list | None = None) -> DataFrame:
    """Reciprocal rank fusion of several queries' hits: the sum of 1 / (30 + rank), ranks from 0; strong if any is."""
    w = Window.partitionBy(query).orderBy(*(order or [F.col("strong").desc(), F.col("score").desc(), "conv", "idx"]))
    ranks = ranked.withColumn("rank", F.row_number().over(w) - 1)
    return ranks.groupBy(key).agg(F.sum(1.0 / (FUSION_K + F.col("rank"))).alias("fused"), F.max("strong").alias("strong"), F.count("*").alias("n_queries"))


def excerpt(content: Column, wanted: list[str], before: int = 160, most: int = 1100) -> Column:
    """Up to `most` characters, from `before` characters ahead of the first wanted term."""
    places = F.filter(F.array(*(F.locate(w, fold(content)) for w in wanted)), lambda p: p > 0)
    at = F.coalesce(F.array_min(places), F.lit(1))
    return F.substring(content, F.greatest(F.lit(1), at - before), F.lit(most))


def matching_lines(pieces: DataFrame, wanted: list[str], around: int = 1, key: str = "rid", content: str = "content") -> DataFrame:
    """Lines that hold a wanted term, with so many lines around each: key, line_no (from 1), line, hit."""
    rows = pieces.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.contains(fold(F.col("line")), F.lit(w))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-around, around)
    near = rows.withColumn("hit", hit).withColumn("near", F.max("hit").over(w))
    return near.where("near").select(key, (F.col("pos") + 1).alias("line_no"), "line", "hit")
