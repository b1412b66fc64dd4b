"""The corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage works on all rows that its predecessor kept and, but for the last, returns
the columns of documents. Extra columns ride along, whatever their names. An empty
table passes every stage empty. Null and empty texts go in the first stage, having no
quality; so do very long texts if they are bad, and whole. Ties (groups of equal
documents, rows of one id) are decided by the least id, then by the least hash of the
row, so a rerun after a lost executor keeps the same rows. Rows with a null id are
documents of their own up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.llm import bpe, jaccard, mixing, quality, secret_scan
from quillspark.llm.common import stored, table
from quillspark.llm.queries import tokenizer


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; host is the source, path the language within it.

    Two passes over the texts: the sites' sums, then the decision. No text is shuffled.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    site = [F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path")]
    sums = stored(quality.with_evidence(docs.select(*site, "text"), model).drop("text"), "pipeline-evidence")
    # a row rides along as one column, so that no column of it can clash
    scored = quality.with_evidence(docs.select(F.struct(*docs.columns).alias("row"), *site), model, "row.text")
    return quality.posterior(scored, quality.sites(sums), model.prior if model else 0.5).where("kept").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; of the rows of one id, the one of the least hash. Rows with a null id stay.

    What is dropped is written as ids, so the planner broadcasts it only if it is small. Rows of one id are found by
    their ids; their texts alone are ordered, and where no id repeats, none are. Equal rows are one.
    """
    groups = stored(jaccard.join(docs).select("doc_id", "component_id").distinct(), "pipeline-groups")
    dropped = stored(groups.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-dropped")
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    kept = docs.join(dropped, "doc_id", "left_anti")
    once = kept.join(repeated, "doc_id", "left_anti")
    least = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.sha2(F.to_json(F.struct(*docs.columns)), 256)))
    many = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), least.alias("nth")).where("nth = 1").select("row.*")
    return once.select(docs.columns).unionByName(many)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the text of every secret replaced by a mark; n_chars follows."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that raking gives their source, language and topic."""
    _, cell = mixing.mix(docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"))
    return mixing.assign(rows, cell).where("kept").select("row.*")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return bpe.digests(docs, *tokenizer())


STAGES = [("quality", by_quality), ("near_duplicates", without_near_duplicates), ("secrets", without_secrets), ("mixing", mixed), ("tokens", tokenized)]

#: Learned models and tokens aren't expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each other stage's are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
