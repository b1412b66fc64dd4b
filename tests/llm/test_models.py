"""Language identification, quality classification, quality rules: accuracy held out, edges, brute force."""

import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, quality, queries, rules

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@needs_tables
def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    train = spark.createDataFrame([(i, ("the of and " if i % 2 else "der die und ") * 20, "en" if i % 2 else "de") for i in range(60)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    net = langid.fit(train)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the of and the of"), (5, "und der die und"), (6, "the and of " * 50_000)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["und", "und", "und", "en", "de", "en"]
    assert got[1]["score"] == 0.0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(empty) is None and langid.predict(empty, net).count() == 0
    assert langid.predict(train.select("doc_id", "text"), None).first()["lang_pred"] == "und"


def test_language_ids_ties_and_many_languages(spark):
    """Null ids aren't held out; equal ids train in a fixed order; no language is dropped; clashing columns don't matter."""
    rows = [(1 if i % 3 else None, f"w{i % 300} " * 30, f"l{i % 300:03d}", "x") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    assert df.where(langid.held_out().isNull()).count() == 0 and df.where("doc_id is null").where(langid.held_out()).count() == 0
    nets = [langid.fit(df.repartition(n)) for n in (1, 5)]
    assert len(nets[0].langs) == 300
    assert all((a == b).all() for a, b in zip(nets[0].filters, nets[1].filters, strict=True))
    assert langid.predict(df, nets[0]).count() == 900
    ids = spark.createDataFrame([(i, t, y) for i, (_, t, y, _) in enumerate(rows)], "doc_id long, text string, lang string")
    few = langid.fit(ids, sample=200)
    assert few is not None and len(few.langs) < 200


def test_network_windows_equal_plain_convolution():
    net = langid.Net(["a", "b"], seed=3)
    text = bytes(np.random.default_rng(1).integers(1, 255, 700, dtype=np.uint8))
    padded = text + b"\0" * (3 * langid.WINDOW - len(text) + langid.PAD)
    total = np.zeros(2)
    for k in range(3):
        pooled = []
        for w, f in zip(langid.WIDTHS, net.filters, strict=True):
            z = [sum(f[o][padded[p + o]] for o in range(w)) for p in range(k * langid.WINDOW, (k + 1) * langid.WINDOW)]
            pooled.append(np.max(z, axis=0))
        total += net._softmax(np.concatenate(pooled)[None])[0] * min(langid.WINDOW, len(text) - k * langid.WINDOW)
    assert np.allclose(net.predict([text])[0], total / total.sum(), atol=1e-5)


@needs_tables
def test_quality_keeps_clean_and_rejects_bad(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.op7_quality_classifier(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = out.join(labels, "doc_id").collect()
    good, bad = [r for r in got if r["quality"] is not None and r[-2] == 1], [r for r in got if r[-2] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_sparse_sites_shrink(spark):
    rows = [("big", "big/a", 0.9)] * 300 + [("low", "low/a", 0.2)] * 300 + [("tiny", "tiny/a", 0.0)] + [(None, "x", None)]
    ev = spark.createDataFrame(rows, "host string, path string, evidence double")
    got = {r["host"]: r for r in quality.sites(ev).collect()}
    share = got["big"]["global_share"]
    assert abs(got["big"]["path_posterior"] - 0.9) < 0.02 and abs(got["low"]["path_posterior"] - 0.2) < 0.02
    assert 0.0 < got["tiny"]["path_posterior"] < share and got[None]["path_posterior"] == pytest.approx(share)


def plain_sites(rows):
    """{(host, path): (n, host posterior, path posterior)} and the share of all, of rows (host, path, p), in plain Python."""
    e = quality._EDGE
    clip = lambda x, low, high: min(max(x, low), high)
    sums, hosts = {}, {}
    for h, q, p in rows:
        for key, held in (((h, q), sums), (h, hosts)):
            n, s = held.get(key, (0, 0.0))
            held[key] = (n, s) if p is None else (n + 1, s + p)

    def strength(level, base):
        seen = [(n, s / n, base(k)) for k, (n, s) in level.items() if n]
        total, v = sum(n for n, _, _ in seen), sum(n * b * (1 - b) for n, _, b in seen)
        if not total or not v:
            return 10.0
        noise = v / total
        spread = max(0.0, sum(n * (m - b) ** 2 for n, m, b in seen) - len(seen) * noise) / total
        return clip(noise / spread - 1 if spread > 0 else 1e6, 1.0, 1e6)

    n, s = sum(x for x, _ in hosts.values()), sum(x for _, x in hosts.values())
    share = clip(s / n if n else 0.5, e, 1 - e)
    k0 = strength(hosts, lambda _: share)
    host = {h: (s + k0 * share) / (n + k0) for h, (n, s) in hosts.items()}
    k1 = strength(sums, lambda k: host[k[0]])
    return {(h, q): (n, host[h], (s + k1 * host[h]) / (n + k1)) for (h, q), (n, s) in sums.items()}, share


def plain_quality(p, prior, site):
    if p is None:
        return 0.0
    logit = lambda x: np.log(x / (1 - x))
    z = logit(p) - logit(prior) + logit(min(max(site, quality._EDGE), 1 - quality._EDGE))
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("seed", [1, 2])
def test_sites_and_posterior_equal_plain_python(spark, seed):
    """Repeated rows, null hosts, paths and evidence, a host without any evidence; columns of the operator's own names."""
    rng = np.random.default_rng(seed)
    hosts = [None, "a", "b", "c", "d"]
    rows = []
    for _ in range(400):
        h = hosts[rng.integers(5)]
        q = None if rng.random() < 0.1 else f"{h}/{rng.integers(3)}"
        p = None if h == "d" or rng.random() < 0.1 else round(float(np.clip(rng.beta(2, 2) * (0.4 if h == "a" else 1), 0.001, 0.999)), 6)
        rows.append((h, q, p))
    rows += rows[:40]
    ev = spark.createDataFrame([(i, *r, 7) for i, r in enumerate(rows)], "doc_id long, host string, path string, evidence double, extra int")
    want, share = plain_sites(rows)
    table = quality.sites(ev)
    got = {(r["host"], r["path"]): r for r in table.collect()}
    assert set(got) == set(want)
    for k, (n, h, q) in want.items():
        assert (got[k]["path_n"], got[k]["global_share"]) == (n, pytest.approx(share))
        assert (got[k]["host_posterior"], got[k]["path_posterior"]) == (pytest.approx(h), pytest.approx(q))
    out = {r["doc_id"]: r for r in quality.posterior(ev, table, 0.6).collect()}
    assert len(out) == len(rows)
    for i, (h, q, p) in enumerate(rows):
        assert out[i]["quality"] == pytest.approx(plain_quality(p, 0.6, want[h, q][2])) and out[i]["kept"] == (out[i]["quality"] >= quality.KEEP_AT)


def test_evidence_beside_clashing_names(spark):
    """A column of the name is replaced; very long texts and repeated ids each have their evidence."""
    docs = spark.createDataFrame([(1, "plain words in a row here", 5.0), (1, "plain words in a row here", 6.0), (None, "word " * 300_000, 7.0)], "doc_id long, text string, evidence double")
    got = quality.with_evidence(docs, None).collect()
    assert [r["evidence"] for r in got] == [0.5] * 3 and len(got[0]) == 3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words here")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model is None
    ev = quality.with_evidence(docs.select("doc_id", F.lit(None).cast("string").alias("host"), F.lit("p").alias("path"), "text"), model)
    got = {r["doc_id"]: (r["evidence"], r["kept"]) for r in quality.posterior(ev, quality.sites(ev), 0.5).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (0.5, True)}
    none = ev.limit(0)
    assert quality.posterior(none, quality.sites(none), 0.5).count() == 0


def brute_figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = {}
    for i in range(len(w) - 7):
        runs.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_figures_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = ["", None, " \n ", "a", "é # 😀", "x\n\nx\n x\nx", "one two three four five six seven eight " * 3] + [" ".join(rng.choice(list("abc") + ["d\n", "\x0b", "*"], rng.integers(1, 120))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    for r in rules.figures(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_figures(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(900):
        r = {k: float(rng.random()) for k in rules.RATIOS}
        r["bad"] = bool(r["symbol_share"] > 0.7 and r["upper_share"] <= 0.4) or bool(r["bang_share"] > 0.95)
        rows.append(r)
    learned = rules.learn(rows)
    assert 2 <= len(learned) <= 4
    wrong = sum(any(all(c.holds(r) for c in rule) for rule in learned) != r["bad"] for r in rows)
    assert wrong <= 0.03 * len(rows)
    assert rules.learn([]) == [] and rules.learn([r | {"bad": False} for r in rows]) == []


def test_verdict_column_equals_the_list(spark):
    """The first rule that holds, by Condition.holds, on figures with null, equal and very long texts, repeated and null ids."""
    rng = np.random.default_rng(12)
    texts = [None, "", "word " * 100_000, "a ! b ! c ! " * 9] + [" ".join(rng.choice(["abc", "De", "!", "#x", "word word", "line\n"], rng.integers(1, 90))) for _ in range(250)]
    df = spark.createDataFrame([(None if i % 50 == 0 else i // 2, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, rule string")
    stats = rules.figures(df)
    rows = [r.asDict() for r in stats.select("*", *[F.expr(e).cast("double").alias(k) for k, e in rules.RATIOS.items()]).collect()]
    lists = [[(rules.Condition("bang_share", True, 0.2), rules.Condition("word_length", False, 3.0)), (rules.Condition("distinct_share", False, 0.3),), (rules.Condition("upper_share", True, 0.05), rules.Condition("repeat_share", False, 0.5))], []]
    for learned in lists:
        got = sorted(map(str, [(r["doc_id"], r["n_words"], r["word_chars"], r["rule"], r["kept"]) for r in rules.apply(stats, learned).collect()]))
        want = []
        for r in rows:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            first = next((i for i, rule in enumerate(learned, 1) if all(c.holds(r) for c in rule)), None)
            want.append(str((r["doc_id"], r["n_words"], r["word_chars"], None if failed else first, not failed and first is None)))
        assert got == sorted(want)
        assert not learned or len({x.rsplit(",", 2)[1] for x in got}) >= 3


@needs_tables
def test_rules_keep_clean_documents(spark):
    got = queries.op4_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)


def test_rules_on_empty_tables(spark):
    stats = rules.figures(spark.createDataFrame([], "doc_id long, text string"))
    assert rules.apply(stats, rules.fit(stats, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    one = rules.figures(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    r = rules.apply(one, []).first()
    assert r["base_failed"] and not r["kept"]
