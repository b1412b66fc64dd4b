"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are WORDS of them. A
template of n shingles is sought in windows of 2 s shingles at steps of s, s being
the next power of two from n on, so that a window holds every occurrence whole. Of
a window that holds a share AT_LEAST of a template, the Jaccard similarity with it
is AT_LEAST * n / (2 s + (1 - AT_LEAST) * n) or more, 0.18 for n just over s / 2.
BANDS bands of one row each miss such a window with probability 0.82 ** 48 at
most, under 0.0001. Windows without any shingle of a template have similarity 0
and cannot collide, so they get no bands.

Templates that share half of their shingles form a family and have one step; of a
family, a window reports those that it holds most of (all of them on a tie), so
that a notice isn't also taken for its near relations.

Null text counts as empty: no licenses. Texts shorter than a window are one
window. An empty table gives no rows. Every row gives a row of its own: repeated
and null ids too, each with what its own text holds. Very long texts are scanned
whole, window by window. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stored

WORDS = 3
BANDS = 48
AT_LEAST = 0.8
#: Up to this number of shingles and band values of all templates, those that none has are dropped early by a literal; it changes no result.
MOST_LITERALS = 4096

#: Notices of public licenses, by SPDX identifier; by the family's name where a notice is common to versions.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "GPL": ("under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "LGPL": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, wherever the planner moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column) -> Column:
    """The shingles of a text in order, as hashes."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    # everything in ASCII but letters and digits cuts words; all beyond ASCII counts as a letter
    hashes = F.transform(F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    none = F.array().cast("array<bigint>")
    return _let(hashes, lambda h: F.when(F.size(h) >= WORDS, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))).otherwise(none))


def templates(spark: SparkSession, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, list[int], int, int]]:
    """(license, distinct shingles, family, step) of every notice. As large as texts, which is a parameter."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(t).alias("t")) for name, ts in texts.items() for t in ts]
    df = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    got = df.select("license", F.array_distinct(shingles(F.col("t"))).alias("s")).collect()
    if short := [r["license"] for r in got if not r["s"]]:
        raise ValueError(f"notices of fewer than {WORDS} words: {short}")
    sets = [set(r["s"]) for r in got]
    family = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if family[j] != family[i] and 2 * len(a & sets[j]) >= min(len(a), len(sets[j])):
                family = [family[j] if f == family[i] else f for f in family]
    longest = {f: max(len(s) for s, g in zip(sets, family, strict=True) if g == f) for f in family}
    return [(r["license"], list(r["s"]), f, _step(longest[f])) for r, f in zip(got, family, strict=True)]


def _bands(s: Column, step: Column) -> Column:
    """The least of BANDS hashes over a set, each told apart by its band and step."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.array_min(F.transform(s, lambda x: F.xxhash64(x, b))), b, step))


def _step(n: int) -> int:
    return max(4, 1 << (n - 1).bit_length())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row per row of docs: id, n_licenses, licenses (sorted, comma-joined), n_windows that hold one."""
    spark = docs.sparkSession
    known = templates(spark, texts)
    literal = lambda xs: F.array(*[F.lit(x) for x in xs])
    every = sorted({x for _, s, _, _ in known for x in s})
    may = F.arrays_overlap("s", literal(every)) if len(every) <= MOST_LITERALS else F.size("s") > 0
    # the table of templates and their bands is written, so that the planner broadcasts it only if it is small
    one = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), literal(s).alias("ts"), F.lit(family).alias("family"), F.lit(step).alias("step")) for i, (name, s, family, step) in enumerate(known)]
    table = spark.range(1).select(F.explode(F.array(*one)).alias("r")).select("r.*")
    table = stored(table.withColumn("keys", _let(F.col("ts"), lambda s: _bands(s, F.col("step")))), "license-templates")
    keys = table.select("template", F.explode(F.array_distinct("keys")).alias("key"))

    # a row is known by a number of its own, written once; only texts with a template's shingle keep theirs
    rows = docs.select(F.col(id_col).alias("id"), shingles(F.col(text_col)).alias("s"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.when(may, F.col("s")).alias("s")), "license-candidates")
    near = rows.where("s is not null")
    windows = near.select("row", "s", F.explode(literal(sorted({step for *_, step in known}))).alias("step"))
    windows = windows.select("row", "s", "step", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("s") - 1) / F.col("step")) - 1).cast("int"))).alias("nth"))
    windows = windows.select("row", "step", "nth", F.array_distinct(F.slice("s", F.col("nth") * F.col("step") + 1, F.col("step") * 2)).alias("s")).where(may)
    windows = stored(windows, "license-windows")
    met = windows.select("row", "step", "nth", F.explode(_let(F.col("s"), lambda s: _bands(s, F.col("step")))).alias("key")).join(keys, "key").select("row", "step", "nth", "template").distinct()
    held = met.join(windows, ["row", "step", "nth"]).join(table.select("template", "license", "family", "ts"), "template")
    held = held.select("row", "step", "nth", "family", "license", (F.size(F.array_intersect("s", "ts")) / F.size("ts")).alias("share")).where(F.col("share") >= AT_LEAST)
    most = held.groupBy("row", "step", "nth", "family").agg(F.max("share").alias("most"), F.collect_set(F.struct("share", "license")).alias("all"))  # a set no larger than texts
    most = most.select("row", "step", "nth", F.explode(F.filter("all", lambda x: x["share"] == F.col("most"))).alias("x"))
    found = most.groupBy("row").agg(F.collect_set("x.license").alias("found"), F.count_distinct("step", "nth").alias("n_windows"))
    out = near.select("row", "id").join(found, "row", "left").select("id", F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))
    out = out.unionByName(rows.where("s is null").select("id", F.array().cast("array<string>").alias("found"), F.lit(0).cast("long").alias("n_windows")))
    return out.select(F.col("id").alias(id_col), F.size("found").cast("long").alias("n_licenses"), F.array_join(F.sort_array("found"), ",").alias("licenses"), "n_windows")
