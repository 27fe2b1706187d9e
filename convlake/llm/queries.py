"""The operators' queries over the given tables, and the SQL that states the same results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm.common import store, table
from convlake.llm.embedding_dedup import embedding_dedup
from convlake.llm.exact_dedup import exact_dedup
from convlake.llm.filter_audit import duckdb_sql as filter_audit_sql
from convlake.llm.filter_audit import filter_audit
from convlake.llm.html_extract import extract
from convlake.llm.language_id import language_id
from convlake.llm.license_scan import duckdb_sql as license_sql
from convlake.llm.license_scan import license_scan
from convlake.llm.line_dedup import line_dedup
from convlake.llm.ngram_join import ngram_jaccard_join
from convlake.llm.packing import pack
from convlake.llm.phrases import collocations
from convlake.llm.phrases import duckdb_sql as phrases_sql
from convlake.llm.quality import quality
from convlake.llm.sentencepiece_codec import round_trip
from convlake.llm.token_rollup import TokenRollup, bpe_counts, deleted, inserted, revised, word_counts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def _rolled_up(spark: SparkSession, sf_dir: str, counts: DataFrame, *versions: str) -> DataFrame:
    """Documents come in with a guess of four characters a token for each tokenizer version, are counted by each, and those labelled toxic
    are taken out; that batch comes twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counts = store(counts, "token-counts")
    guess = docs.select("doc_id", "source", "lang", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("n_tokens"))
    guess = store(guess.withColumn("version", F.explode(F.array(*map(F.lit, versions)))), "token-guesses")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    rollup = TokenRollup(spark)
    rollup.commit(1, inserted(guess))
    rollup.commit(2, revised(guess, counts))
    rollup.compact()
    for _ in range(2):
        rollup.commit(3, deleted(counts.join(toxic, "doc_id", "left_semi")))
    return rollup.totals()


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _rolled_up(spark, sf_dir, bpe_counts(docs).unionByName(word_counts(docs)), "byte_bpe_50k", "words")


def word_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rollup over counts that SQL can state."""
    return _rolled_up(spark, sf_dir, word_counts(table(spark, sf_dir, "documents")), "words")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return ops | {"word_count_rollup": word_count_rollup}


OP2 = r"""
WITH line AS (
  SELECT d.doc_id, u.pos, u.line, trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       LATERAL (SELECT unnest(d.lines) AS line, generate_subscripts(d.lines, 1) AS pos) u
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, f.key IS NOT NULL AND l.doc_id < f.last_doc AS gone FROM line l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


WORD_COUNTS = r"""
SELECT source, lang, 'words' AS version, count(*) AS docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
GROUP BY source, lang
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op9_exact_dedup": OP9, "op10_license_scan": license_sql(), "op12_phrase_collocations": phrases_sql(), "op13_filter_interaction_audit": filter_audit_sql(), "word_count_rollup": WORD_COUNTS}
