"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import scratch, ship, stored

__all__ = ["SPACE_CLASS", "STEP_BYTES", "binary_views", "byte_texts", "char_offset", "join_by_key", "partitions", "scratch", "sha", "ship", "steps", "stored", "table", "text_steps", "tidy", "trim"]

#: Text bytes that one vectorised step takes; bounds a Python worker's memory.
STEP_BYTES = 2 << 20

#: The white space that ends a word.
SPACE_CLASS = r" \t\n\x0B\f\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null gives empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def text_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a column with their texts, of at most limit bytes; a longer text stands alone. Only one range is held."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i, byte_texts(column.slice(start, i - start))
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield start, len(sizes), byte_texts(column.slice(start))


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, after which the worker, which goes on to other tasks, keeps no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            trim()

    return run


def binary_views(column: pa.Array, kind: type = np.uint64) -> list[np.ndarray]:
    """The values of a column of packed arrays, without copies; nulls aren't expected."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    return [np.frombuffer(data, kind, (b - a) // size, a) if b > a else np.zeros(0, kind) for a, b in zip(offsets, offsets[1:], strict=False)]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def char_offset(raw: bytes, at: int) -> int:
    """Code points before byte offset at."""
    b = np.frombuffer(raw, np.uint8, count=at)
    return int(np.count_nonzero((b & 0xC0) != 0x80))


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: A key is hot from this part of all rows on; so there are no more hot keys than this.
HOT = 1000


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, copies: str, made: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    """rows, and of the fact with a row's key the columns that made gives, or nulls.

    facts has one row a key, a SHA-256 as binary, and a column of how many rows share it. Facts of hot keys, HOT of
    them at most, are broadcast. Rows that meet one go on under a number of their own, so no key of the second join
    has more than a HOT-th of the rows. There the planner broadcasts the rest of facts if it is small.
    """
    (total,) = facts.agg(F.coalesce(F.sum(copies), F.lit(0))).first()
    is_hot = F.col(copies) * HOT >= F.lit(total)
    parts = {name: made(facts.where(c)) for name, c in (("few", is_hot), ("many", ~is_hot))}
    others = [c for c in parts["few"].columns if c != key]
    few, many = (t.select(F.col(key).alias(f"{name}_key"), F.struct(*others).alias(name)) for name, t in parts.items())
    own = F.unhex(F.hex(F.xxhash64(F.monotonically_increasing_id())))  # shorter than a SHA-256
    out = rows.join(F.broadcast(few), F.col(key) == F.col("few_key"), "left")
    out = out.withColumn("many_at", F.when(F.col("few").isNull(), F.col(key)).otherwise(own))
    out = out.join(many, F.col("many_at") == F.col("many_key"), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("few").getField(c), F.col("many").getField(c)).alias(c) for c in others])
