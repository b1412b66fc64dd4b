"""Answers of a model under the hash of what was asked: written step by step, so none is asked for twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..cluster import children, stored
from .scorers import Generate, call

ANSWER = "request_id string, raw string, ok boolean, attempts int, error string"


def request_id(messages: Column, schema: Column, tokens: Column, model: str = "") -> Column:
    """The hash of all that an answer hangs on."""
    return F.sha2(F.concat_ws("\u0001", F.lit(model), messages, schema, tokens.cast("string")), 256)


@dataclass(frozen=True)
class Ledger:
    """Answers in a folder, a table a step.

    ask() looks requests up by their hash and calls the model for those that lack a good answer, each once however
    many rows ask it, batch of them at a time. A batch is written before the next begins: a run that stops repeats at
    most one batch of calls. Failed calls are kept for the record and asked again by the next run.
    """

    folder: str
    model: str = ""
    batch: int = 50_000

    def _known(self, df: DataFrame, step: str) -> DataFrame:
        spark, path = df.sparkSession, f"{self.folder.rstrip('/')}/step={step}"
        parts = children(spark, path)
        return spark.read.schema(ANSWER).parquet(*parts) if parts else spark.createDataFrame([], ANSWER)

    def _last(self, df: DataFrame, step: str) -> DataFrame:
        """An answer a request: a good one if there is any."""
        one = F.struct("ok", "attempts", "raw", "error")
        return self._known(df, step).groupBy("request_id").agg(F.max(one).alias("a")).select("request_id", "a.raw", "a.ok", "a.attempts", "a.error")

    def ask(self, step: str, requests: DataFrame, generate: Generate, keys: tuple[str, ...], tokens: int = 8192, retries: int = 1) -> DataFrame:
        """keys, raw, ok, attempts, error of requests (keys, messages, schema, and tokens if they have budgets of their own). requests are read more than once: give a written table."""
        messages = F.col("messages") if requests.schema["messages"].dataType.simpleString() == "string" else F.to_json("messages")
        schema = F.col("schema") if "schema" in requests.columns else F.lit("{}")
        budget = F.col("tokens") if "tokens" in requests.columns else F.lit(tokens)
        rows = requests.select(*keys, messages.alias("messages"), schema.alias("schema"), budget.cast("int").alias("tokens"))
        rows = rows.withColumn("request_id", request_id(F.col("messages"), F.col("schema"), F.col("tokens"), self.model))
        good = self._known(requests, step).where("ok").select("request_id")
        lacking = rows.join(good, "request_id", "left_anti").select("request_id").distinct()
        lacking = stored(lacking, "ledger-lacking")
        parts = -(-lacking.count() // self.batch)
        for i in range(parts):
            mine = lacking.where(F.pmod(F.xxhash64("request_id"), F.lit(parts)) == i)
            one = rows.join(mine, "request_id", "left_semi").dropDuplicates(["request_id"])
            call(one.select("request_id", "messages", "schema", "tokens"), generate, ("request_id",), retries=retries).write.mode("append").parquet(f"{self.folder.rstrip('/')}/step={step}")
        return rows.select(*keys, "request_id").join(self._last(requests, step), "request_id", "left").drop("request_id")
