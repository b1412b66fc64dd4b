"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import common, resample


def grams(text, longest=1):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [" ".join(words[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plainly(rows, target, longest=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    """(id, n_features, weight, score, rank) of every row; rows of equal id and score share the set of their ranks."""
    bucket = lambda g: crc32(g) % buckets
    found = [(i, *grams(t, longest)) for i, t in rows]
    s = Counter(bucket(g) for _, _, gs in found for g in gs)
    t = Counter(bucket(g) for x in target for g in grams(x, longest)[1])
    all_s, all_t = s.total(), t.total()
    out = []
    for i, n, gs in found:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, gs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return sorted([(*x[:4], k + 1) for k, x in enumerate(drawn)] + [(*x[:4], None) for x in able[len(drawn) :]] + [(*x[:4], None) for x in out if not x[4]], key=str)


def corpus(n=400):
    rng = random.Random(12)
    words = ["Alpha", "beta", "gamma", "déjà", "日本", "x1", "İ", "École", "the", "of"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += [texts[5]] * 150 + [texts[7]] * 20 + ["", None, " ", "a-b_c.d", "!?"]
    rows = list(enumerate(texts))
    rows += [(3, "the same id with another text " * 8), (None, texts[9]), (2, texts[2]), (2, texts[2])]
    rows.append((9000, " ".join(rng.choice(words) + str(rng.randrange(50_000)) for _ in range(60_000))))
    return rows


TARGET = ["alpha alpha the of x1", "déjà Alpha", None, "", "alpha alpha the of x1"]


def run(spark, rows, target=TARGET, **how):
    docs = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, key string, copies int, place string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, resample.resample(docs, goal, **how).collect()), key=str)


def test_equals_plain_python(spark):
    rows = corpus()
    assert run(spark, rows) == plainly(rows, TARGET)


def test_longer_features_and_few_buckets(spark):
    rows = corpus(60)
    how = {"longest": 3, "buckets": 50, "percent": 30, "min_words": 5, "seed": 7}
    assert run(spark, rows, **how) == plainly(rows, TARGET, **how)


def test_pieces_do_not_change_counts(monkeypatch):
    text = (" ".join(f"W{i % 97} é{i % 13}" for i in range(3000)) + "z" * 1000).encode()
    whole = resample.counted(text, 2, 1000)
    monkeypatch.setattr(resample, "PIECE", 64)
    n, at, many = resample.counted(text, 2, 1000)
    assert n == whole[0]
    assert dict(zip(at.tolist(), many.tolist(), strict=True)) == dict(zip(whole[1].tolist(), whole[2].tolist(), strict=True))


def test_no_rows_no_target_nothing_drawn(spark):
    assert run(spark, []) == []
    rows = corpus(30)
    assert run(spark, rows, []) == plainly(rows, [])
    few = rows[:9]  # a tenth of nine is none
    assert all(r[4] is None for r in run(spark, few)) and run(spark, few) == plainly(few, TARGET)


def test_one_id_of_many_rows_goes_to_many_ranges(spark):
    n = 4000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("id"), F.lit(5).cast("long").alias("score"), F.col("id").alias("place"))
    out = resample.ranked(rows, "id")
    assert sorted(r["rank"] for r in out.select("rank").collect()) == list(range(1, n + 1))
    assert all(r["rank"] == r.place + 1 for r in out.collect())
    sizes = [r["count"] for r in rows.repartitionByRange(4, F.desc("score"), "id", "place").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < n / 2


def test_hot_and_other_keys_join_alike(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = [(i, bytes([i % 7]) * 32) for i in range(100)] + [(100 + i, bytes([9]) * 32) for i in range(200)] + [(300, bytes([8]) * 32), (301, None)]
    many = Counter(k for _, k in rows if k and k[0] != 8)
    facts = spark.createDataFrame([(k, n, k[0]) for k, n in many.items()], "key binary, copies long, first int")
    got = common.join_by_key(spark.createDataFrame(rows, "id long, key binary"), facts, "key", "copies", lambda t: t.select("key", "first"))
    assert got.columns == ["id", "key", "first"]
    assert {(r.id, r.first_) for r in got.withColumnRenamed("first", "first_").collect()} == {(i, k[0] if k and k[0] != 8 else None) for i, k in rows}


def test_sample_gives_the_drawn_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows if i is not None], "doc_id long, text string")
    drawn = resample.resample(docs, spark.createDataFrame([(t,) for t in TARGET], "text string"))
    wanted = {r.doc_id for r in drawn.collect() if r["rank"] is not None}
    assert {r.doc_id for r in resample.sample(docs, drawn).collect()} == wanted and wanted
    assert np.isfinite([r.score for r in drawn.collect()]).all()
