"""License scans, preference formatting, mixing, nearest neighbours."""

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillspark.llm import ann, licenses, mixing, preference, queries

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def grams(w):
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def brute_licenses(text, known):
    """The best of every family in every window, with plain sets; known: (license, shingles, family, step)."""
    s, out = grams(words(text)), set()
    best = {}
    for name, t, family, step in known:
        for start in range(0, max(1, ((len(s) - 1) // step) * step), step):
            share = len(t & set(s[start : start + 2 * step])) / len(t)
            if share >= licenses.AT_LEAST:
                best.setdefault((family, step, start), []).append((share, name))
    for found in best.values():
        out |= {name for share, name in found if share == max(found)[0]}
    return sorted(out)


def known_licenses(spark):
    notices = [(name, set(grams(words(n)))) for name, ns in licenses.TEMPLATES.items() for n in ns]
    got = licenses.templates(spark)
    assert [(name, len(t)) for name, t in notices] == [(x[0], len(x[1])) for x in got]
    return [(*n, *x[2:]) for n, x in zip(notices, got, strict=True)]


def license_texts():
    rng = random.Random(10)
    notices = [n for ns in licenses.TEMPLATES.values() for n in ns]
    texts = ["", None, "MIT", *notices]
    for _ in range(200):
        w = [rng.choice("alpha beta gamma the license licensed under work is".split()) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.7:
            n = rng.choice(notices).split()
            if rng.random() < 0.4:
                n[rng.randrange(len(n))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = n
        texts.append(" ".join(w))
    return texts


def test_licenses_equal_brute_force(spark):
    texts = license_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, s string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert len(got) == len(texts)
    known = known_licenses(spark)
    for i, t in enumerate(texts):
        assert got[i]["licenses"] == ",".join(brute_licenses(t, known)), t
        assert got[i]["n_licenses"] == len(brute_licenses(t, known))
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_rows_stand_alone(spark, monkeypatch):
    """Null and repeated ids, a very long text, equal rows, clashing columns; relations of a family; no literals."""
    mit = "Released under the MIT License."
    rows = [(None, mit), (2, "nothing here at all"), (2, mit), (2, mit), (None, None), (7, "word " * 300_000 + mit), (8, "")]
    want = sorted([(None, "MIT"), (2, ""), (2, "MIT"), (2, "MIT"), (None, ""), (7, "MIT"), (8, "")], key=str)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, family string")
    assert sorted(((r["doc_id"], r["licenses"]) for r in licenses.scan(df).collect()), key=str) == want
    for name in ("GPL", "LGPL", "AGPL", "GPL-2.0", "GPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"):
        one = spark.createDataFrame([(1, f"and so on. {licenses.TEMPLATES[name][-1]} and more")], "doc_id long, text string")
        assert licenses.scan(one).first()["licenses"] == name
    monkeypatch.setattr(licenses, "MOST_LITERALS", 0)
    short = df.where("length(text) < 100")
    assert sorted(((r["doc_id"], r["licenses"]) for r in licenses.scan(short).collect()), key=str) == [x for x in want if x[0] not in (7,) and x != (None, "")]


@needs_tables
def test_licenses_in_the_tables(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r["licenses"] for r in queries.op2_license_scan(spark, SF).collect()}
    for d, t in rows:
        for line, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")):
            assert (line not in t) or name in got[d]


def pairs(spark, chosen, rejected):
    rows = [(0, i, *x) for i, x in enumerate(chosen)] + [(1, i, *x) for i, x in enumerate(rejected)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    got = preference.format_pairs(preference.turns(df, (df["conv_id"] / 2).cast("long"), df["conv_id"] % 2 == 0)).collect()
    want = con.sql(preference.NEIGHBOURS_SQL).fetchall()
    assert [tuple(r[c] for c in ("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")) for r in got] == want
    return got


def test_preferences(spark):
    u, a, b = ("user", "hé"), ("assistant", "yes"), ("assistant", "no")
    r = pairs(spark, [u, a, u, a], [u, a, u, b])[0]
    assert r["n_prompt_turns"] == 3 and r["prompt"] == "<|user|>\nhé<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nhé<|end|>\n"
    assert r["chosen"] == "<|assistant|>\nyes<|end|>\n"
    s, e = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][s:e] == "yes<|end|>"
    r = pairs(spark, [u, a], [u, a])[0]
    assert (r["n_prompt_turns"], r["chosen"], r["rejected"], r["chosen_mask"]) == (2, "", "", "")
    r = pairs(spark, [u, a], [u])[0]
    assert r["n_prompt_turns"] == 1 and r["rejected"] == "" and r["chosen_mask"]
    r = pairs(spark, [a, u], [b, (None, None)])[0]
    assert r["n_prompt_turns"] == 0 and r["prompt"] == ""
    assert pairs(spark, [u], []) == []


PAIR = ("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


@needs_tables
def test_preferences_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.op3_preference_format(spark, SF).collect()
    assert sorted(tuple(r[c] for c in PAIR) for r in got) == sorted(con.sql(preference.SWAPPED_SQL).fetchall())
    assert sum(r["prompt"] != "" for r in got) >= len(got) / 2 and sum(r["chosen"] != r["rejected"] for r in got) >= len(got) / 2


def test_swapped_edges(spark):
    """Repeated and null turns, a null id, no assistant, a gap in the numbers, a very long text, clashing columns, an empty table."""
    long = "word " * 200_000
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "user", None), (2, 0, None, "x"), (2, None, "assistant", long), (3, 0, "user", "z"), (5, 0, "assistant", "q"), (6, 0, "assistant", "q"), (None, 0, "assistant", "q")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn int, role string, text string, pair_id int, chosen string")
    got = preference.format_pairs(preference.swapped(df)).collect()
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(tuple(r[c] for c in PAIR) for r in got) == sorted(con.sql(preference.SWAPPED_SQL).fetchall())
    by = {r["pair_id"]: r for r in got}
    assert set(by) == {1, 5} and by[1]["n_prompt_turns"] == 2 and long in by[1]["rejected"] and by[5]["chosen"] == by[5]["rejected"] == ""
    assert preference.format_pairs(preference.swapped(df.limit(0))).count() == 0


def mixed(spark, n=4000, **kwargs):
    rng = random.Random(11)
    rows = [(i, f"s{min(3, int(rng.expovariate(1)))}", rng.choice(["en", "en", "en", "de", None]), "a" * rng.randint(1, 9) + (" | b c" if rng.random() < 0.3 else " b")) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    return mixing.mix(df, **kwargs)


def test_raking_meets_every_margin(spark):
    docs, cell = mixed(spark)
    cells = cell.collect()
    assert max(r["off"] for r in cells) < 1e-6 and abs(sum(r["weight"] for r in cells) - 1) < 1e-9
    for m in mixing.MARGINS:
        by = {}
        for r in cells:
            by.setdefault(r[m], [0.0, r[f"to_{m}"]])[0] += r["weight"]
        assert all(abs(a - b) < 1e-6 for a, b in by.values()) and abs(sum(b for _, b in by.values()) - 1) < 1e-9
    rows = docs.collect()
    assert len(rows) == 4000 and all(0 <= r["probability"] <= 1 for r in rows)
    expected = sum(r["probability"] * r["tokens"] for r in rows)
    assert abs(expected - mixing.RATE * sum(r["tokens"] for r in rows)) < 1e-6 * expected
    drawn = sum(r["tokens"] for r in rows if r["kept"])
    assert abs(drawn - expected) < 0.05 * expected
    again = {r["doc_id"]: r["kept"] for r in mixed(spark)[0].collect()}
    assert again == {r["doc_id"]: r["kept"] for r in rows}


def test_draw_meets_the_targets_beside_full_cells(spark):
    """A value that is short of its target is taken whole, the others share the rest in proportion, and the other margins are met."""
    rng = random.Random(3)
    rows = [(i, rng.choice("abcd"), rng.choice(["en", "en", "en", "de"]), "x " * rng.randint(5, 30) + ("@" if i % 40 == 0 else " | " if i % 3 == 0 else "")) for i in range(3000)]
    docs, cell = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"))
    cells = cell.collect()
    total = sum(r["n"] for r in cells)
    drawn = sum(r["probability"] * r["n"] for r in cells)
    assert abs(drawn - mixing.RATE * total) < 1e-6 * total
    share = {m: {} for m in mixing.MARGINS}
    for r in cells:
        for m in mixing.MARGINS:
            s = share[m].setdefault(r[m], [0.0, r[f"to_{m}"], 0, r[f"gap_{m}"]])
            s[0] += r["probability"] * r["n"] / drawn
            s[2] += r["n"]
    for m in mixing.MARGINS:
        assert all(abs(x / to - 1 - gap) < 1e-6 for x, to, _, gap in share[m].values())
        short = {v for v, (_, to, n, _) in share[m].items() if n < to * mixing.RATE * total}
        assert short == ({"contact"} if m == "topic" else set())
        assert all(abs(share[m][v][0] * drawn - share[m][v][2]) < 1e-6 * total for v in short)
        rest = [x / to for v, (x, to, _, _) in share[m].items() if v not in short]
        assert max(rest) - min(rest) < 1e-6
    # at a rate that the tokens allow, no gap is left
    _, cell = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), rate=0.2)
    assert max(abs(r[f"gap_{m}"]) for r in cell.collect() for m in mixing.MARGINS) < 1e-6


def plain_raking(cells, rate):
    """(weight, probability) of cells [(values, tokens)] by raking in plain numpy, to convergence, without windows or tables."""
    n = np.array([c[1] for c in cells], float)
    at = [np.unique([c[0][m] for c in cells], return_inverse=True)[1] for m in range(3)]
    total = n.sum()
    to = []
    for i in at:
        share = (np.bincount(i, n) / total) ** mixing.POWER
        share[np.bincount(i, n) == 0] = 0
        to.append(share / share.sum())
    w = n / total
    for _ in range(5000):
        for i, t in zip(at, to, strict=True):
            held = np.bincount(i, w)
            w = w * np.where(held > 0, t / np.where(held > 0, held, 1), 0)[i]
        if max(np.abs(np.bincount(i, w) - t).max() for i, t in zip(at, to, strict=True)) < 1e-14:
            break

    def least(x, cap, goal):
        """x times a factor found by halving, so that sum(min(cap, x * factor)) is goal, or all of cap."""
        if cap[x > 0].sum() <= goal:
            return np.where(x > 0, np.inf, 0)
        low, high = 0.0, 1.0
        while np.minimum(cap, x * high).sum() < goal:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(cap, x * mid).sum() < goal else (low, mid)
        return x * high

    whole = rate * total
    goals = [np.minimum(least(t, np.bincount(i, n), whole), np.bincount(i, n)) for i, t in zip(at, to, strict=True)]
    x = w * whole
    for _ in range(3000):
        last = x.copy()
        for i, g in zip(at, goals, strict=True):
            for v in range(len(g)):
                own = i == v
                x[own] = np.minimum(least(x[own], n[own], g[v]), 1e30)
        if np.abs(np.minimum(x, n) - np.minimum(last, n)).max() < 1e-9:
            break
    return w, np.minimum(x, n) / np.where(n > 0, n, 1)


def test_raking_equals_plain_raking(spark):
    """Weights and probabilities of every cell; with null values, ties, and a value that is short of its target."""
    rng = random.Random(21)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice(["en", "en", "en", "de", None]), "x " * rng.randint(5, 30) + ("@" if i % 40 == 0 else " | " if i % 3 == 0 else "")) for i in range(1500)]
    _, cell = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), rate=0.5)
    got = sorted(((r["source"], r["lang"], r["topic"]), r["n"], r["weight"], r["probability"]) for r in cell.collect())
    weight, probability = plain_raking([(values, n) for values, n, _, _ in got], 0.5)
    assert len(got) > 30
    assert np.allclose([x[2] for x in got], weight, atol=1e-9)
    assert np.allclose([x[3] for x in got], probability, atol=1e-6)


def test_mixing_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "a", "en", "x y", 5, 0.5, "k"), (1, "a", "en", "x y", 5, 0.5, "k"), (2, "b", "en", "word " * 200_000, 1, 0.1, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, tokens int, weight double, topic string")
    docs, _ = mixing.mix(df)
    got = docs.collect()
    assert sorted(r["tokens"] for r in got) == [2, 2, 200_000]
    assert len({(r["doc_id"], r["kept"]) for r in got}) == 2  # rows of one id share one fate


def test_targets_and_edges(spark):
    docs, _ = mixed(spark, targets={"source": {"s0": 1.0, "s1": 1.0, "unknown": 5.0}})
    rows = docs.collect()
    assert all(r["probability"] == 0 and not r["kept"] for r in rows if r["source"] not in ("s0", "s1"))
    empty = spark.createDataFrame([], "doc_id long, source string, lang string, text string")
    assert mixing.mix(empty)[0].count() == 0
    no_text = spark.createDataFrame([(1, None, None, None), (None, "a", "b", "")], "doc_id long, source string, lang string, text string")
    assert [r["tokens"] for r in mixing.mix(no_text)[0].collect()] == [0, 0]


def test_chi_square_quantiles():
    for p, dims, want in ((0.95, 1, 3.841459), (0.95, 10, 18.307038), (0.5, 16, 15.338499)):
        assert ann.chi_square_quantile(p, dims) == pytest.approx(want, abs=1e-5)


@needs_tables
def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert ann.recall(df, queries.op5_nearest_neighbours(spark, SF)) >= 0.95


def test_recall_over_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "MOST_TASKS", 2)
    monkeypatch.setattr(ann, "TOGETHER", 7)
    rng = np.random.default_rng(12)
    v = rng.normal(size=(900, 24)) * rng.uniform(0.5, 2, (900, 1))
    v[100:400] = v[100]
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, id int")
    found = ann.search(df)
    assert ann.recall(df, found) >= 0.95
    by = {}
    for r in found.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append(r)
    assert len(by) == 45 and all([r["rank"] for r in rs] == list(range(1, 21)) for rs in by.values())
    assert [r["vec_id"] for r in by[120]] == list(range(100, 120))  # equal vectors go by id
    for rs in by.values():
        for r in rs:
            assert r["score"] == pytest.approx(float(v[r["query_id"]] @ v[r["vec_id"]]), rel=1e-12)


def test_vectors_that_take_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(1, 5)] + [(20, [1.0, 1.0])]
    odd = [(40, None), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (160, [])]
    df = spark.createDataFrame([(*x, 1, 2) for x in good + odd], "vec_id long, embedding array<double>, block int, d int")
    got = ann.search(df).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(20, 4), (20, 3), (20, 2), (20, 1)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def by_query(df):
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_vectors_of_any_magnitude_and_length_take_part(spark):
    """Finite vectors however large or small; lengths meet their own; a repeated query is answered once."""
    rows = [(20, [1e200, 1e200]), (40, [1e-200, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1e200, 1e200])]
    got = by_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [v for v, _ in got[20]] == [2, 1, 40, 3] and got[20][0][1] == 2e200
    assert got[40] == [(20, 1.0), (2, 2e-200), (1, 1e-200), (3, -1.0)]
    big = by_query(spark.createDataFrame([(20, [1e200]), (1, [1e200]), (2, [1.0])], "vec_id long, embedding array<double>"))
    assert big[20] == [(1, float("inf")), (2, 1e200)]
    rows = [(20, [1.0, 0.0]), (1, [3.0, 0.0]), (40, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (20, [1.0, 0.0]), (60, [5.0])]
    got = by_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got == {20: [(1, 3.0)], 40: [(2, 2.0)]}


def test_search_stops_before_all_is_verified():
    """In clustered vectors the stopping test holds after a part of the leaves, and finds the same."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 4
    v = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32)) * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    block = ann.Block(np.arange(6000), v, float(np.abs(v).max()), 1.000001 / float(np.abs(v).max()))
    ids, _, tried = block.nearest(np.arange(100), v[:100])
    assert tried < 0.2 * 100 * 6000
    for i in range(100):
        s = ann.score(v, v[i])
        s[i] = -np.inf
        assert len(set(ids[i].tolist()) & set(np.lexsort((np.arange(6000), -s))[:20].tolist())) >= 18
