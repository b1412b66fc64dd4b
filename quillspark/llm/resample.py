"""Importance resampling towards a target: documents whose words look like the target's are drawn more often.

Identical texts are collapsed by grouping the full text, so a text is read, counted
and weighed once, however often it occurs; its counts enter the corpus's sums times
its copies. Features are runs of words, hashed to buckets. A bucket's gain is the
logarithm of its share in the target over its share in the corpus, both smoothed by
one; a text's weight is the mean gain of its features. Weights go back to documents by
the text's SHA-256, and each document adds Gumbel noise of its own: the highest scores
are a draw without replacement in proportion to the weights.

The few texts that hold a thousandth of all rows or more are joined by a broadcast (at
most a thousand rows), the rest by an exchange, in which no key can be hot. Ranks come
from ranges of (score, id, row), so neither many equal scores nor one id of many rows
falls to one task.

Null text counts as empty: no features, weight 0. A null id draws its noise by the
empty string and ranks after other ids. Repeated rows each give a row; rows of equal
score and id rank in the order in which they were read. Very long texts are counted
whole, a piece at a time. An empty table gives no rows; with an empty target all
gains still have values. Extra columns, of any name, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_by_key, partitions, ship, stored, text_steps, tidy

BUCKETS = 10_000
LONGEST = 1  # words of a feature
PERCENT = 10
MIN_WORDS = 20
SEED = 2024

#: Words are runs of letters, digits and all that isn't ASCII; only A-Z becomes lower case. All other bytes part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = len(text) if at + PIECE >= len(text) else at + PIECE
        if end < len(text):  # up to the end of a word
            gap = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].translate(_FOLD).split()
        at = end


def counted(text: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of words, buckets, how many features fall in each)."""
    n, found, tail = 0, Counter(), []
    for words in pieces(text):
        n += len(words)
        found.update(words)
        if longest > 1:
            tail += words
            new = len(tail) - len(words)  # words that the piece before has counted
            for size in range(2, longest + 1):
                found.update(b" ".join(tail[i : i + size]) for i in range(max(0, new - size + 1), len(tail) - size + 1))
            tail = tail[-(longest - 1) :]
    at = np.fromiter((crc32(f) % buckets for f in found), np.int32, len(found))
    many = np.fromiter(found.values(), np.int64, len(found))
    if len(at) > buckets:
        sums = np.zeros(buckets, np.int64)
        np.add.at(sums, at, many)
        at = np.flatnonzero(sums).astype(np.int32)
        many = sums[at]
    return n, at, many


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def features(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """A row for each different text: its key, copies, n_words, n_features, and its buckets with their counts."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, step in text_steps(batch.column(0)):
                found = [counted(t, longest, buckets) for t in step]
                sizes = pa.array([int(c.sum()) for _, _, c in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array([n for n, _, _ in found], pa.int64()), sizes, _lists([x for _, x, _ in found], pa.int32()), _lists([x for _, _, x in found], pa.int64())],
                    names=["copies", "key", "n_words", "n_features", "buckets", "counts"],
                )

    made = texts.select("text", "copies", key(F.col("text")).alias("key"))
    return made.mapInArrow(tidy(rows), "copies long, key binary, n_words long, n_features long, buckets array<int>, counts array<long>")


def key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and where each list begins."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all copies of all texts: one array of a fixed size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            at, offsets = _flat(batch.column(1))
            many, _ = _flat(batch.column(2))
            np.add.at(out, at, many * np.repeat(batch.column(0).to_numpy(), np.diff(offsets)))
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(out[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("copies", "buckets", "counts").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of a bucket's smoothed share in the target over that in the corpus."""
    n = len(corpus)
    s, t, all_s, all_t = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features and weight of each text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, offsets = _flat(batch.column(4))
            many, _ = _flat(batch.column(5))
            run = np.concatenate([[0], np.cumsum(gain[at] * many)])
            n = batch.column(3).to_numpy()
            weight = np.where(n > 0, (run[offsets[1:]] - run[offsets[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], names=["key", "copies", "n_words", "n_features", "weight"])

    return rows.select("key", "copies", "n_words", "n_features", "buckets", "counts").mapInArrow(weigh, "key binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of a document's own Gumbel number g."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def highest(scored: DataFrame, share: int) -> int | None:
    """The share-th highest score. Scores are whole numbers within some hundred thousand, however many rows there are, and so are the counts by score."""
    left = share
    for r in scored.groupBy("score").count().orderBy(F.desc("score")).collect():
        left -= r["count"]
        if left <= 0:
            return r.score
    return None


def ranked(rows: DataFrame, id_col: str) -> DataFrame:
    """rows and their rank by (score down, id up, place up), from ranges that are written with the place in the range."""
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("place")]
    sorted_rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = stored(sorted_rows.select("*", F.spark_partition_id().alias("part"), nth.alias("nth")), "resample-ranges")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return parts.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("nth") + 1).drop("part", "nth", "before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row a document: its id, n_features, weight, score, and rank, which is null unless it is drawn.

    Of the N documents of min_words or more, N * percent // 100 are drawn.
    """
    texts = stored(features(docs, text_col, longest, buckets), "resample-features")
    wanted = totals(features(target, target_text, longest, buckets), buckets)
    gain = gains(totals(texts, buckets), wanted)
    rows = docs.select(F.col(id_col).alias("id"), key(F.col(text_col)).alias("key"))
    rows = join_by_key(rows, texts, "key", "copies", lambda t: weighed(t, gain).drop("copies"))
    scored = rows.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), F.monotonically_increasing_id().alias("place"))
    scored = stored(scored, "resample-scores")
    able = scored.where(F.col("n_words") >= min_words)
    share = able.count() * percent // 100
    least = highest(able, share) if share else None
    is_candidate = F.lit(False) if least is None else (F.col("n_words") >= min_words) & (F.col("score") >= least)
    drawn = ranked(scored.where(is_candidate), "id").withColumn("rank", F.when(F.col("rank") <= share, F.col("rank")))
    out = drawn.unionByName(scored.where(~is_candidate).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn, whole."""
    return docs.join(drawn.where("rank is not null").select(id_col).distinct(), id_col, "left_semi")


#: DuckDB's version of resample(documents, benchmark), with the defaults. The checksum's table comes from its polynomial.
RESAMPLE_SQL = """
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
byte_table AS (SELECT list(c ORDER BY i) AS steps FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
f AS (SELECT row, unnest(words) AS word FROM d),
known AS (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || hex(encode(word))[2 * i - 1:2 * i])::BIGINT)),
    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM f UNION SELECT word FROM b), byte_table),
s AS (SELECT bucket, count(*) AS n FROM f JOIN known USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM b JOIN known USING (word) GROUP BY 1),
size AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS of_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS of_t),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (of_s + 10000) / ((s.n + 1)::DOUBLE * (of_t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), size),
w AS (SELECT row, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN known USING (word) JOIN gain USING (bucket) GROUP BY 1),
x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, coalesce(weight, 0) AS weight
  FROM d LEFT JOIN w USING (row)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS nth, count(*) FILTER (n_features >= 20) OVER () AS able FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= able * 10 // 100 THEN nth END AS rank FROM r"""
