"""Retrieval by many questions at once, and how much of their evidence the answers show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import estimate_tokens, terms
from convlake.operators.search import B, K1, LEAST_IDF

# How many calls a question may make, and the places that the first of them is judged by.
MOST_CALLS, FIRST_PLACES = 5, 5


def answers(pieces: DataFrame, calls: DataFrame, limit: int, chars: int) -> DataFrame:
    """The best pieces (conv, idx, rid, content) for each call (qid, call, words): qid, call, place, rid, strong, score, text, tokens.

    BM25 with the statistics of all pieces; words of a call count once. Equal scores go by conv and idx, strong pieces hold all of a call's
    words, text is the piece's first `chars` characters. The words of all calls meet the pieces' words in one equi-join, of counts only, and
    texts are fetched for the pieces that are shown.
    """
    asked = calls.select("qid", "call", F.array_distinct("words").alias("words")).select("qid", "call", F.size("words").alias("n_words"), F.explode("words").alias("term"))
    words = pieces.select("conv", "idx", "rid", terms(F.col("content")).alias("toks")).withColumn("dl", F.size("toks"))
    stats = words.agg(F.count("*").alias("n_all"), F.avg("dl").alias("avgdl"))
    counts = words.select("conv", "idx", "rid", "dl", F.explode("toks").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "conv", "idx", "rid", "dl").agg(F.count("*").alias("f"))
    # a term's pieces are counted apart from its postings, so that no task holds all of a frequent one
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = counts.join(weights, "term").groupBy("qid", "call", "conv", "idx", "rid", "n_words").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("n_found"))
    best = Window.partitionBy("qid", "call").orderBy(F.desc("score"), "conv", "idx")
    shown = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    text = pieces.select("conv", "idx", F.substring("content", 1, chars).alias("text"))
    return shown.join(text, ["conv", "idx"]).select("qid", "call", "place", "rid", (F.col("n_found") == F.col("n_words")).alias("strong"), "score", "text", estimate_tokens(F.col("text")).alias("tokens"))


def _shows(text: str, pattern: str) -> Column:
    """Whether a pattern is found in a text: as it stands, with white space as one space, or with escaped quotes and line ends undone."""
    dot_all = F.concat(F.lit("(?s)"), F.col(pattern))
    plain = F.replace(F.replace(F.col(text), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.rlike(F.col(text), dot_all) | F.rlike(F.regexp_replace(text, r"\s+", " "), dot_all) | F.rlike(plain, dot_all)


def scores(questions: DataFrame, evidence: DataFrame, calls: DataFrame, shown: DataFrame) -> DataFrame:
    """One row for each question (qid, kind, neg): n_groups, covered, e5, eb, rank, rr, n_calls, tokens, strong.

    evidence: qid, grp, rids, pattern. A call covers a group if it shows one of its pieces and the pattern is in what it shows. e5: the
    first call covers all groups by pieces in its first five places. Calls (qid, call from 1) are made in order, at most five, until all
    groups are covered; eb: they are in the end; tokens and strong are those of the calls that are made. rank: the first place of any
    evidence in the first call, rr its reciprocal or 0. A question without evidence has e5 and eb false and makes all its calls.
    """
    made = calls.where(F.col("call") <= MOST_CALLS).select("qid", "call").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("place", "rid", "text")))
    # what a call shows is bounded by its places
    given = shown.groupBy("qid", "call").agg(ordered.alias("o"), F.sum("tokens").alias("call_tokens"), F.bool_or("strong").alias("call_strong"))
    given = made.join(given.select("qid", "call", F.col("o.rid").alias("shown"), F.filter("o", lambda x: x["place"] <= FIRST_PLACES)["rid"].alias("first_shown"), F.array_join("o.text", "\n").alias("out"), "call_tokens", "call_strong"), ["qid", "call"], "left")
    groups = evidence.select("qid", "grp", "rids", "pattern")
    hits = groups.join(given, "qid").where(F.arrays_overlap("rids", "shown") & _shows("out", "pattern"))
    early = (F.col("call") == 1) & F.arrays_overlap("rids", "first_shown")
    by_group = hits.groupBy("qid", "grp").agg(F.min("call").alias("first_call"), F.bool_or(early).alias("early"))
    covered = by_group.groupBy("qid").agg(F.count("*").alias("covered"), F.max("first_call").alias("last_needed"), F.count_if("early").alias("n_early"))
    ranked = shown.where("call = 1").join(groups.select("qid", F.explode("rids").alias("rid")).distinct(), ["qid", "rid"]).groupBy("qid").agg(F.min("place").alias("rank"))
    whole = questions.join(groups.groupBy("qid").agg(F.count("*").alias("n_groups")), "qid", "left").join(covered, "qid", "left").join(ranked, "qid", "left").fillna(0, ["n_groups", "covered", "n_early"])
    whole = whole.withColumn("eb", (F.col("n_groups") > 0) & (F.col("covered") == F.col("n_groups"))).withColumn("e5", (F.col("n_groups") > 0) & (F.col("n_early") == F.col("n_groups")))
    spent = whole.select("qid", F.when(F.col("eb"), F.col("last_needed")).alias("until")).join(given, "qid").where("until IS NULL OR call <= until")
    spent = spent.groupBy("qid").agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("call_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.bool_or("call_strong"), F.lit(False)).alias("strong"))
    rr = F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return whole.join(spent, "qid", "left").select("qid", "kind", "neg", "n_groups", "covered", "e5", "eb", "rank", rr, zero("n_calls"), zero("tokens"), F.coalesce("strong", F.lit(False)).alias("strong"))


def summary(scored: DataFrame) -> DataFrame:
    """By kind of question, and over all of them (kind null): n, e5, eb, mrr, tokens and calls of the positive ones, neg_n and neg_ok (no
    strong piece) of the negative ones."""
    mean = lambda x: F.round(F.avg(F.when(~F.col("neg"), x.cast("double"))), 6)
    named = {"e5": "e5", "eb": "eb", "mrr": "rr", "tokens": "tokens", "calls": "n_calls"}
    columns = [mean(F.col(c)).alias(k) for k, c in named.items()]
    return scored.rollup("kind").agg(F.count_if(~F.col("neg")).alias("n"), *columns, F.count_if("neg").alias("neg_n"), F.count_if(F.col("neg") & ~F.col("strong")).alias("neg_ok"))
