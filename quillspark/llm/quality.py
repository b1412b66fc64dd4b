"""Quality classification by hierarchical empirical Bayes.

A logistic model gives each document evidence from figures of its bytes and
words; it is trained on a bounded sample of labelled rows (MAX_LABELS, chosen by
a hash). Grouped aggregation sums the evidence by path and host. A host's
posterior shrinks towards the global share and a path's towards its host's, each
by a prior strength that the method of moments takes from the spread between
sites. The path's posterior is then the prior of its documents.

Null hosts and paths are sites of their own. Text that is null or without a word
has quality 0 and is rejected. Without labels, evidence is 0.5 throughout and
every document with a word stays. Repeated rows and ids, and null ids, each count
and each give a row. An empty table gives no rows. Very long texts are read whole.
Extra columns ride along; those of the names that the operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import ship, stored, text_steps, tidy

MAX_LABELS = 8000
#: A document stays from this quality on.
KEEP_AT = 0.5
_EDGE = 1e-4

#: Groups of bytes whose shares are figures of a text.
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&<>", b"|", b"!", b".,;:'\"()?-", b"@/_=+[]{}~^`\\", bytes(range(128, 256)))
_GROUP = np.zeros((256, len(GROUPS)))
for _k, _g in enumerate(GROUPS):
    _GROUP[list(_g), _k] = 1
WIDTH = 2 * len(GROUPS) + 5


def figures(text: bytes) -> np.ndarray:
    """Shares of the byte groups and their logarithms, repeats of neighbouring and of all words, word length, size."""
    out = np.zeros(WIDTH)
    words = text.split()
    if not words:
        return out
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _GROUP / len(text)
    k, n = len(GROUPS), len(words)
    out[:k] = share
    out[k : 2 * k] = np.log(share + 1e-3)
    out[2 * k] = sum(map(eq, words, words[1:])) / n
    out[2 * k + 1] = len(set(words)) / n
    out[2 * k + 2] = np.log(n)
    out[2 * k + 3] = np.log(len(text) / n)
    out[2 * k + 4] = np.log(out[2 * k] + 1e-3)
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.weight
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), _EDGE, 1 - _EDGE)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Ridge logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w, float(np.clip(y.mean(), 0.01, 0.99)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> Logistic | None:
    """Learn from at most max_labels labelled documents; None without both classes."""
    ship(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").orderBy(F.xxhash64("id", F.lit("quality")), "id", "y").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [figures(t).tolist() for _, _, texts in text_steps(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("id", "t", "y").mapInArrow(tidy(run), f"id {kind}, y double, x array<double>").orderBy(F.xxhash64("id", F.lit("quality")), "id", "y", "x").limit(max_labels).collect()
    y = np.array([float(r["y"] >= 0.5) for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return train(np.array([r["x"] for r in got]), y)


def with_evidence(docs: DataFrame, model: Logistic | None, text_col: str = "text", name: str = "evidence") -> DataFrame:
    """docs and a column of the model's probability, in place of one of that name; null for a text without a word. text_col may be a field of a struct: row.text."""
    ship(docs.sparkSession)
    outer, _, inner = text_col.partition(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            column = pc.struct_field(column, inner) if inner else column
            x = np.array([figures(t) for _, _, texts in text_steps(column) for t in texts]).reshape(-1, WIDTH)
            p = model(x) if model else np.full(len(x), 0.5)
            empty = ~x.any(axis=1)
            yield batch.append_column(name, pa.array(np.where(empty, np.nan, p), mask=empty))

    docs = docs.drop(name)
    at = docs.columns.index(outer)
    return docs.mapInArrow(tidy(run), f"{docs._jdf.schema().toDDL()}, `{name}` double")


def sites(evidence: DataFrame, host: str = "host", path: str = "path", p: str = "evidence") -> DataFrame:
    """Posteriors of every (host, path): grouped sums, shrunk level by level. One row a path."""
    by_path = evidence.groupBy(host, path).agg(F.count(p).alias("n"), F.coalesce(F.sum(F.col(p).cast("decimal(38,9)")).cast("double"), F.lit(0.0)).alias("s"))
    by_path = stored(by_path, "paths")
    by_host = by_path.groupBy(host).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    by_host = stored(by_host, "hosts")

    def strength(level: DataFrame, n: str, s: str, base: F.Column) -> float:
        """Prior counts: share's variance over the spread between sites beyond what chance gives."""
        seen = level.where(F.col(n) > 0).select(F.col(n).alias("n"), (F.col(s) / F.col(n)).alias("m"), base.alias("b"))
        r = seen.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("b")) ** 2).alias("q"), F.sum(F.col("n") * F.col("b") * (1 - F.col("b"))).alias("v"), F.count("*").alias("k")).first()
        if not r["n"] or not r["v"]:
            return 10.0
        noise = r["v"] / r["n"]
        spread = max(0.0, r["q"] - r["k"] * noise) / r["n"]
        return float(np.clip(noise / spread - 1 if spread > 0 else 1e6, 1.0, 1e6))

    total = by_host.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    share = float(np.clip((total["s"] or 0.0) / total["n"] if total["n"] else 0.5, _EDGE, 1 - _EDGE))
    k0 = strength(by_host, "host_n", "host_s", F.lit(share))
    host_post = ((F.col("host_s") + k0 * share) / (F.col("host_n") + k0)).alias("host_posterior")
    hosts = stored(by_host.select(host, "host_n", host_post), "host-posteriors")
    right = hosts.withColumnRenamed(host, "_h")
    joined = by_path.join(right, by_path[host].eqNullSafe(right["_h"])).drop("_h")
    k1 = strength(joined, "n", "s", F.col("host_posterior"))
    return stored(joined.select(host, path, F.col("n").alias("path_n"), "host_posterior", ((F.col("s") + k1 * F.col("host_posterior")) / (F.col("n") + k1)).alias("path_posterior"), F.lit(share).alias("global_share")), "path-posteriors")


def posterior(evidence: DataFrame, site_table: DataFrame, prior: float, host: str = "host", path: str = "path", p: str = "evidence", keep_at: float = KEEP_AT) -> DataFrame:
    """evidence with the site's columns, quality and kept: the document's likelihood ratio times its path's odds."""
    right = site_table.withColumnsRenamed({host: "_h", path: "_p"})
    logit = lambda c: F.log(c / (1 - c))
    clip = lambda c: F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), c))
    z = logit(F.col(p)) - float(np.log(prior / (1 - prior))) + logit(clip(F.col("path_posterior")))
    evidence = evidence.drop(*[c for c in ("path_n", "host_posterior", "path_posterior", "global_share", "quality", "kept") if c in evidence.columns])
    out = evidence.join(right, evidence[host].eqNullSafe(right["_h"]) & evidence[path].eqNullSafe(right["_p"]), "left").drop("_h", "_p")
    quality = F.when(F.col(p).isNull(), F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))
    return out.withColumn("quality", quality).withColumn("kept", F.col("quality") >= keep_at)
