"""The queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, fim, jaccard, langid, licenses, mixing, preference, quality, resample, rules, secret_scan, warc
from .common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> tuple[str, str]:
    """The rank file and pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no preferences: a conversation is chosen, and rejected with the next one's last answer in place of its own."""
    return preference.format_pairs(preference.swapped(table(spark, sf_dir, "conversations")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(rules.figures(table(spark, sf_dir, "documents")), "figures")
    out = rules.apply(stats, rules.fit(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "kept", *[f"gap_{m}" for m in mixing.MARGINS])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host is a document's source, path its language within the source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    rows = quality.with_evidence(docs.select("doc_id", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"), "text"), model).drop("text")
    rows = stored(rows, "evidence")
    out = quality.posterior(rows, quality.sites(rows), model.prior if model else 0.5)
    return out.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, net)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join, op2_license_scan, op3_preference_format, op4_quality_rules, op5_nearest_neighbours, op6_mixing, op7_quality_classifier,
            op8_language_id, op9_secret_scan, op10_byte_bpe, op11_fill_in_middle, op12_importance_resampling, op13_warc_round_trip,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_format": preference.SWAPPED_SQL, "op11_fill_in_middle": fim.DIGESTS_SQL, "op12_importance_resampling": resample.RESAMPLE_SQL, "op13_warc_round_trip": warc.ROUND_TRIP_SQL}
