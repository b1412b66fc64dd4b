"""A table of rows by key that is written batch by batch and read one bucket at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..cluster import children, is_complete, remove


@dataclass(frozen=True)
class Keyed:
    """Rows by key under path. Of a key's rows the one of the greatest order counts.

    Each batch is a folder, replaced if the batch is tried again. compact() merges all batches into one folder. All
    folders are cut by the first two characters of the key's hash, so a look-up reads one bucket of the last merged
    folder and of the few batches since.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str = "job_id"
    order: tuple[str, ...] = ("at",)

    def _bucket(self, key: Column) -> Column:
        return F.substring(F.sha2(key.cast("string"), 256), 1, 2)

    def _written(self, kind: str) -> dict[int, str]:
        """Number -> folder of complete writes."""
        found = {int(f.rpartition("=")[2]): f for f in children(self.spark, f"{self.path}/{kind}")}
        return {n: f for n, f in sorted(found.items()) if is_complete(self.spark, f)}

    def _parts(self) -> list[str]:
        merged, batches = self._written("merged"), self._written("log")
        upto = max(merged, default=-1)
        return [merged[n] for n in list(merged)[-1:]] + [f for n, f in batches.items() if n > upto]

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("bucket", self._bucket(F.col(self.key))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch:012d}")

    def _last(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        one = F.struct(*[c for c in rows.columns if c != self.key])
        return rows.groupBy(self.key).agg(F.max_by(one, F.struct(*self.order)).alias("last")).select(self.key, "last.*")

    def rows(self) -> DataFrame:
        return self._last([f for p in self._parts() for f in children(self.spark, p)])

    def of(self, key: str) -> DataFrame:
        """The row of a key, if there is one: what its bucket holds is read, no more."""
        return self._last(self.folders_of(key)).where(F.col(self.key) == key)

    def folders_of(self, key: str) -> list[str]:
        (bucket,) = self.spark.range(1).select(self._bucket(F.lit(key))).first()
        found = (f"{p}/bucket={bucket}" for p in self._parts())
        return [f for f in found if children(self.spark, f)]

    def compact(self) -> None:
        """Merge what was written so far. What the merge before this one made needless goes, so a reader that began before this one is done in time."""
        batches, merged = self._written("log"), self._written("merged")
        upto = max(batches, default=-1)
        if upto in merged or upto < 0:
            return
        self.rows().withColumn("bucket", self._bucket(F.col(self.key))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/merged/upto={upto:012d}")
        before = max(merged, default=-1)
        for folder in [f for n, f in batches.items() if n <= before] + [f for n, f in merged.items() if n < before]:
            remove(self.spark, folder)
