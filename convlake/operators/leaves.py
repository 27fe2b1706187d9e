"""Which parts of an output a question is about: units ranked inside their own text, and the choice among them.

A unit's terms are counted inside its row, so what is shuffled for a question is a few numbers for each unit. Statistics are one row per
text, and what is chosen is at most MAX_BLOCKS units of each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import STOP_WORDS

# Endings of file names, whose words are no terms of a question; units chosen at most; how near a second reading must come;
# the weight of an identifier, and what is left of a unit's score whose path names the opposite of what is asked for.
FILE_ENDINGS = frozenset("yaml yml json toml xml csv md txt log py ini conf cfg tsv html js ts sh".split())
MAX_BLOCKS, NEAR, IDENTIFIER_WEIGHT, OPPOSITE = 10, 0.9, 2.0, 0.35
WORD = "[0-9a-zà-öø-ÿ]+"


def question_terms(question: str | None, stop: tuple[str, ...] = STOP_WORDS) -> tuple[list[str], list[str]]:
    """Different words (of two letters or a digit, without stop words) and identifiers (with a mark or a digit inside, or mixed case) of a
    question, in order. A file's name is no identifier, and its words count only if they stand elsewhere, too."""
    text = question or ""
    identifiers, rest = [], text
    for name in re.findall(r"[\w-]+\.\w{1,5}\b", text):
        if name.rsplit(".", 1)[1].lower() in FILE_ENDINGS:
            rest = rest.replace(name, " ")
    for token in re.findall(r"[A-Za-z0-9][\w.\-:/]*\w", text):
        mixed = re.search(r"[-_.:/]", token) or (re.search(r"\d", token) and re.search("[A-Za-z]", token)) or re.search("[a-z][A-Z]", token)
        if len(token) > 2 and mixed and token.rsplit(".", 1)[-1].lower() not in (FILE_ENDINGS if "." in token else ()):
            identifiers.append(token.lower())
    words = [w for w in re.findall(WORD, rest.lower()) if (len(w) > 1 or w.isdigit()) and w not in stop]
    return list(dict.fromkeys(words)), list(dict.fromkeys(identifiers))


def unit_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))


def ranked_units(units: DataFrame, key: str, unit: str, text: str, question: str, path: str | None = None, opposites: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """key, unit, score, got (places of the question's terms that it holds), n_cov (of these, the ones that no more than half of the units
    hold), n and df of its text.

    BM25 inside a text: idf ln(1 + (n - df + 0.5) / (df + 0.5)), identifiers count twice. Where the question names one of two opposites and a
    unit's path the other, the score is cut. Units without a term of the question are kept with score 0; a null text has no terms.
    """
    words, identifiers = question_terms(question)
    toks = units.select(key, unit, F.col(text).alias("_text"), (F.col(path) if path else F.lit("")).alias("_path")).withColumn("_toks", F.explode(F.array(unit_words(F.col("_text")))))
    same = lambda w: lambda t: t == w
    counts = [F.size(F.filter("_toks", same(w))) for w in words]
    counts += [F.regexp_count(F.lower(F.coalesce("_text", F.lit(""))), F.lit(rf"(?<![\w\-.])\Q{i}\E(?![\w\-])")) for i in identifiers]
    against = [w for pair in opposites for w, other in (pair, pair[::-1]) if other in words and w not in words]
    cut = F.arrays_overlap(unit_words(F.col("_path")), F.array(*map(F.lit, against))) if against else F.lit(False)
    rows = toks.select(key, unit, F.size("_toks").alias("dl"), F.array(*counts).alias("f"), cut.alias("cut"))
    every = range(len(counts))
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*(F.count_if(F.get("f", F.lit(i)) > 0) for i in every)).alias("df"))
    rows = rows.join(stats, key)

    def part(i: int) -> Column:
        f, df = F.get("f", F.lit(i)), F.get("df", F.lit(i))
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(f > 0, (1.0 if i < len(words) else IDENTIFIER_WEIGHT) * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.coalesce(F.try_divide("dl", "avgdl"), F.lit(0.0))))).otherwise(0.0)

    score = sum((part(i) for i in every), F.lit(0.0)) * F.when(F.col("cut"), OPPOSITE).otherwise(1.0)
    got = F.filter(F.array(*(F.when(F.get("f", F.lit(i)) > 0, i) for i in every)).cast("array<int>"), lambda i: i.isNotNull())
    n_cov = F.size(F.filter(got, lambda i: 2 * F.get("df", i) <= F.col("n")))
    return rows.select(key, unit, F.round(score, 9).alias("score"), got.alias("got"), n_cov.alias("n_cov"), "n", "df")


def choose(units: DataFrame, key: str, unit: str, text: str, question: str, strict: bool = False, path: str | None = None, opposites: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """key, units (chosen, in order of relevance; at most MAX_BLOCKS), reason (empty, or why there are none): one row per text.

    Chosen are the best unit and all that hold every term of the question that it holds. It must hold a term that tells units apart (in
    no more than MAX_BLOCKS or a quarter of them); if `strict`, also a second one, or one that is an identifier or in three units at most.
    More than MAX_BLOCKS equal units are none. Others with as many telling terms, but different ones, and nearly the best score follow: a
    second reading. Ties go to the smaller unit.
    """
    words, identifiers = question_terms(question)
    if not words and not identifiers:
        return units.select(key).distinct().select(key, F.array().cast(f"array<{units.schema[unit].dataType.simpleString()}>").alias("units"), F.lit("no word").alias("reason"))
    ranked = ranked_units(units, key, unit, text, question, path, opposites)
    order = F.struct((-F.col("n_cov")).alias("a"), (-F.col("score")).alias("b"), F.col(unit).alias("c"))
    best = ranked.groupBy(key).agg(F.min_by(F.struct("score", "got", "n_cov", "n", "df"), order).alias("best"))
    telling = F.filter("best.got", lambda i: F.get("best.df", i) <= F.greatest(F.lit(MAX_BLOCKS), F.expr("best.n div 4")))
    strong = (F.size("best.got") >= 2) | F.exists(telling, lambda i: (i >= len(words)) | (F.get("best.df", i) <= 3))
    rows = ranked.join(best, key)
    equal = (F.col("score") > 0) & (F.size(F.array_except("best.got", "got")) == 0)
    near = (F.col("n_cov") >= F.col("best.n_cov")) & (F.col("score") >= NEAR * F.col("best.score")) & (F.size(F.array_except("got", "best.got")) > 0)
    rows = rows.select(key, unit, order.alias("order"), equal.alias("equal"), (near & ~equal).alias("near")).where("equal OR near")
    # no more than one unit over the limit of each kind has to be looked at
    place = F.row_number().over(Window.partitionBy(key, "equal").orderBy("order"))
    few = rows.withColumn("place", place).where(F.col("place") <= MAX_BLOCKS + 1)
    found = few.groupBy(key).agg(F.count_if("equal").alias("n_equal"), F.array_sort(F.collect_list(F.struct((~F.col("equal")).alias("later"), "place", unit))).alias("found"))
    out = best.join(found, key, "left").join(rows.groupBy(key).agg(F.count_if("equal").alias("all_equal")), key, "left")
    reason = (
        F.when((F.col("best.score") <= 0) | (F.size("best.got") == 0), "no word found").when(F.size(telling) == 0, "no telling word").when(F.lit(strict) & ~strong, "weak match")
        .when(F.col("all_equal") > MAX_BLOCKS, F.concat(F.col("all_equal").cast("string"), F.lit(" equal blocks"))).otherwise("")
    )
    out = out.withColumn("reason", reason)
    chosen = F.slice(F.transform("found", lambda x: x[unit]), 1, MAX_BLOCKS)
    none = F.array().cast(f"array<{units.schema[unit].dataType.simpleString()}>")
    return out.select(key, F.when(F.col("reason") == "", chosen).otherwise(none).alias("units"), "reason")


def select_units(units: DataFrame, key: str, unit: str, text: str, question: str = "", query: str = "", path: str | None = None, opposites: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """key, units, guides: what a query and the user's question choose together, for texts where they choose anything.

    A query that finds one unit decides, with the units of the question beside it if these are others and one or two. Else query and question
    are read as one; what that does not decide, the query's units are. Without a query the question is read strictly.
    """
    query, question = query.strip(), question.strip()
    args = {"path": path, "opposites": opposites}
    none = F.array().cast(f"array<{units.schema[unit].dataType.simpleString()}>")
    alone = choose(units, key, unit, text, question, strict=True, **args).select(key, F.col("units").alias("s")) if question else None
    if not query:
        if not question:
            return units.select(key, none.alias("units"), F.array().cast("array<string>").alias("guides")).limit(0)
        return alone.where(F.size("s") > 0).select(key, F.col("s").alias("units"), F.array(F.lit("question")).alias("guides"))
    rows = choose(units, key, unit, text, query, **args).select(key, F.col("units").alias("q"))
    if question:
        rows = rows.join(alone, key).join(choose(units, key, unit, text, f"{query} \n {question}", **args).select(key, F.col("units").alias("b")), key)
    else:
        rows = rows.withColumn("s", none).withColumn("b", none)
    one, other = F.size("q") == 1, (F.size("s").between(1, 2)) & ~F.arrays_overlap("q", "s")
    picked = F.when(one & other, F.concat("q", "s")).when(one, F.col("q")).when(F.size("b") > 0, F.col("b")).otherwise(F.col("q"))
    both = (one & other) | (~one & (F.size("b") > 0))
    guides = F.when(both, F.array(F.lit("query"), F.lit("question"))).otherwise(F.array(F.lit("query")))
    return rows.select(key, F.slice(picked, 1, MAX_BLOCKS).alias("units"), guides.alias("guides")).where(F.size("units") > 0)


def shared_room(df: DataFrame, keys: list[str], order: list, room: Column | int, size: str = "tokens", frame: int = 0) -> DataFrame:
    """df with granted: rooms shared out fairly in order. Each row may take an equal part of what is left for it and those behind it, after
    a frame for each; what it does not need passes on to those behind. A row never gets more than its size, and all never more than room.

    A row's part is the most that any cut among the rows behind allows: with the sizes in order, the level L up to which all are filled.
    Here rows come one after the other, so the level is folded inside each group, whose sizes alone are held.
    """
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    room = F.lit(room) if isinstance(room, int) else room
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n")))).alias("_rows"), F.max(room).cast("long").alias("_room"))
    start = F.struct(F.greatest(F.lit(0), F.col("_room") - frame * F.size("_rows")).cast("long").alias("room"), F.size("_rows").cast("long").alias("behind"), F.lit(0).cast("long").alias("got"))

    def step(state: Column, row: Column) -> Column:
        got = F.least(row["n"], (state["room"] - state["room"] % state["behind"]) / state["behind"]).cast("long")
        return F.struct((state["room"] - got).alias("room"), (state["behind"] - 1).alias("behind"), got.alias("got"))

    # the fold is run once with all its states kept, not once for each row
    states = F.aggregate("_rows", F.array(start), lambda states, row: F.concat(states, F.array(step(F.element_at(states, -1), row))))
    given = held.select(*keys, F.posexplode(F.slice(F.transform(states, lambda s: s["got"]), 2, F.size("_rows"))).alias("_place", "granted")).withColumn("_at", F.col("_place") + 1)
    return rows.join(given.drop("_place"), [*keys, "_at"]).drop("_at")
