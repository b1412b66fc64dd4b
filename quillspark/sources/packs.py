"""Rows of many documents in few files, and an index that leads to a document's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a file, by default.
ROWS = 1_000_000


def write(df: DataFrame, path: str, by: str = "doc_id", order: Sequence[str] = (), rows: int = ROWS) -> None:
    """Write df as rows // file sorted by document under path/files, and under path/index the first and last document of each file.

    Files are ranges of (by, order): as many as the rows ask for, whatever the number of documents, and a document of
    very many rows goes on from one file to the next. df is read twice, to count and to write. Rows whose by is null
    come first.
    """
    keys = [F.col(c) for c in (by, *order)]
    files = max(1, -(-df.count() // rows))
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/files")
    table = df.sparkSession.read.schema(df.schema).parquet(f"{path}/files")
    index = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(by).alias("first"), F.max(by).alias("last"), F.count("*").alias("rows"))
    index.repartitionByRange(1 + files // 100_000, "first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/index")


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/files")


def files_of(spark: SparkSession, path: str, document: object) -> list[str]:
    """The files that can hold rows of a document: one, but for a document that goes on in the next."""
    index = spark.read.parquet(f"{path}/index")
    found = index.where((F.col("first") <= F.lit(document)) & (F.col("last") >= F.lit(document)))
    return sorted(r["file"] for r in found.select("file").collect())


def read(spark: SparkSession, path: str, document: object, by: str = "doc_id") -> DataFrame:
    """The rows of a document, from its files alone; in these, by the sorted columns' statistics."""
    found = files_of(spark, path, document)
    schema = table(spark, path).schema
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return rows.where(F.col(by) == F.lit(document))
