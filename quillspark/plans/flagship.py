"""The first query end to end: documents to chunks, text figures, and a weighted roll-up by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import chunks, rollup
from .registry import dec
from .text_queries import READ_WORDS, SENTENCES, SYLLABLES

#: The same in SQL. Documents have no blank lines, so a long one is cut to pieces of 1,200 characters.
SQL = rf"""
WITH c AS (SELECT doc_id, source, text, {READ_WORDS} AS words, CAST(len(list_filter({SENTENCES}, lambda x: regexp_matches(x, '\S'))) AS DOUBLE) AS s, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS chars,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> '' AND len(string_split(x, ' ')) >= 4) AS l FROM documents),
n AS (SELECT doc_id, source, s, CAST(len(words) AS DOUBLE) AS w, CAST(coalesce({SYLLABLES}, 0) AS DOUBLE) AS y, CASE WHEN chars = 0 THEN 0 ELSE CAST(ceil(chars / 1200.0) AS BIGINT) END AS pieces,
  len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS n_words, CASE WHEN len(l) = 0 THEN 0.0 ELSE 1 - len(list_distinct(l)) / CAST(len(l) AS DOUBLE) END AS dup FROM c),
r AS (SELECT n.*, quality, quality IS NOT NULL AS counts, (coalesce(quality, 0) * 3 + CASE WHEN dup < 0.5 THEN 2 ELSE 0 END) / 5.0 * 10 AS score, CASE WHEN s > 0 AND w > 0 THEN 0.39 * (w / s) + 11.8 * (y / w) - 15.59 ELSE 0 END AS fk FROM n LEFT JOIN labels USING (doc_id)),
g AS (SELECT source, count(*) AS n_documents, sum(n_words) AS n_words, avg(fk) AS fk, sum(pieces) AS n_chunks, count(*) FILTER (counts) AS k, count(*) FILTER (counts AND score >= 7.5) AS good, count(*) FILTER (score >= 7.5) AS all_good,
  sum(score * n_words) FILTER (counts) AS v, sum(n_words) FILTER (counts) AS weight, sum(score * n_words) AS all_v FROM r GROUP BY source)
SELECT source, n_documents, CAST(n_words AS BIGINT) AS n_words, CAST(fk AS DECIMAL(18,6))::DOUBLE AS fk_grade, CAST(n_chunks AS BIGINT) AS n_chunks, CASE WHEN k > 0 THEN k ELSE n_documents END AS scored_items, CASE WHEN k > 0 THEN good ELSE all_good END AS good_items,
  CAST(printf('%.2f', CASE WHEN k > 0 THEN v / CASE WHEN weight = 0 THEN 1.0 ELSE weight END ELSE all_v / CASE WHEN n_words = 0 THEN 1.0 ELSE n_words END END) AS DOUBLE) AS score_10 FROM g
"""


def evidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row a source: documents, chunks, words, readability and a weighted score.

    A document's labelled quality and its share of lines that don't repeat are its signals; sources are
    sections. Two grouped passes, no self-join; text is read once.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    n = F.size("words").cast("double")
    figures = docs.withColumn("words", T.read_words("text")).select(
        "doc_id",
        "source",
        F.size(chunks.split_text(F.col("text"))).alias("n_chunks"),
        T.word_count("text").alias("n_words"),
        T.flesch_kincaid(F.size(T.read_sentences("text")).cast("double"), n, T.syllable_sum(F.col("words")).cast("double")).alias("fk_grade"),
        T.duplication(T.normalized_lines("text")).alias("duplication"),
    )
    rows = figures.join(labels, "doc_id", "left")
    score = F.coalesce(F.col("quality"), F.lit(0)) * 3 + (F.col("duplication") < 0.5).cast("int") * 2
    subs = rows.withColumn("score_10", (score / rollup.TOP_SCORE * 10).cast("double")).withColumn("counts", F.col("quality").isNotNull())
    subs = subs.withColumns({"sub_weight": F.col("n_words").cast("double"), "n_signals": F.lit(2), "evidence_count": F.col("n_chunks"), "confidence_label": F.lit("high_confidence")})
    sections = rollup.section_scores(subs, ("source",), (), rounded=True)
    totals = rows.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"), dec(F.avg("fk_grade")).alias("fk_grade"))
    return totals.join(sections.select("source", F.col("evidence_count").alias("n_chunks"), "scored_items", "good_items", "score_10"), "source")
