import json
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunks

LONG = "x" * 1300
APP = {
    "doc_type": "fellowship",
    "SUMMARY INFORMATION": {"Title": "A study", "Empty": "", "None": None, "Costs": [1, {"deep": True}]},
    "APPLICATION DETAILS": {"Plain English Summary": "We will help people. " * 3 + "Interoperability matters.", "Detailed Research Plan": LONG, "Data Access": "Year 1", "Dull Area": ["one", "two"]},
    "OTHER": {"SUMMARY BUDGET": "Salaries £30k", "More": "text"},
    "SUMMARY BUDGET": {"a": "£5"},
}


@pytest.fixture(scope="module")
def pool(spark):
    df = spark.createDataFrame([("d1", json.dumps(APP)), ("empty", "{}"), ("bad", "{"), ("none", None)], "doc_id string, raw string")
    return {r["chunk_id"]: r for r in chunks.pool(df).where("doc_id = 'd1'").orderBy("chunk_pos").collect()}


def test_ids_in_order(pool):
    assert list(pool) == ["secpes__001", "secdrp__001_a", "secdrp__001_b", "secda__001", "secda2__001", "secda2__002", "secsb__001", "secsb__002", "secac__001", "secpena__001", "secafa__001"]


def test_paths_and_text(pool):
    assert pool["secda2__002"]["source_path"] == "APPLICATION DETAILS > Dull Area > [1]"
    assert pool["secsb__001"]["source_path"] == "OTHER > SUMMARY BUDGET"
    assert pool["secac__001"]["text"] == "doc_type:\nfellowship\n\nSUMMARY INFORMATION > Title:\nA study\n\nSUMMARY INFORMATION > Costs > [0]:\n1\n\nSUMMARY INFORMATION > Costs > [1] > deep:\nTrue\n\nOTHER > More:\ntext"
    assert pool["secdrp__001_a"]["text"] + pool["secdrp__001_b"]["text"] == LONG


def test_derived(pool):
    plain, form = pool["secpena__001"]["text"], pool["secafa__001"]["text"]
    assert "- source_section=Plain English Summary\n- word_count=14\n- sentence_count=4" in plain and "technical_terms_sample=['interoperability']" in plain
    assert "- parser_sections_detected=7" in form and "- Plain English NLP Analysis: words=" in form and "No high cross-section" in form
    assert not form.endswith("\n")


def split(spark, text, size=10):
    return spark.createDataFrame([(text,)], "t string").select(chunks.split_text(F.col("t"), size).alias("p")).first()["p"]


def test_split(spark):
    assert split(spark, "  ") == [] and split(spark, None) == []
    assert split(spark, " short ") == ["short"]
    assert split(spark, "a" * 10 + " " * 10 + "b") == ["a" * 10, "", "b"]  # a lone paragraph keeps an empty slice
    assert split(spark, "one\n\ntwo\n \n" + "c" * 12) == ["one", "two", "c" * 10, "cc"]
    assert len(split(spark, "d" * 10_000)) == 1000


def test_letters_past_z(spark):
    e = spark.createDataFrame([("d", 0, "S", "S", "x" * 2000, False)], "doc_id string, leaf_pos int, parser_section string, source_path string, text string, whole boolean")
    ids = [r["chunk_id"] for r in chunks.identify(e, 10).orderBy("chunk_pos").collect()]
    assert ids[0] == "secs__001_a" and ids[26] == "secs__001_{" and ids[199] == "secs__001_" + chr(97 + 199) and len(set(ids)) == 200


def test_overlaps_are_ranked(spark):
    rows = [("d", i, f"s{i}", t) for i, t in enumerate(["alpha beta gamma", "alpha beta gamma", "alpha beta delta", "none of these"])]
    got = chunks.overlaps(spark.createDataFrame(rows, "doc_id string, section_pos int, parser_section string, text string")).orderBy("rank").collect()
    assert [(r["section_a"], r["section_b"], r["score"]) for r in got] == [("s0", "s1", 1.0), ("s0", "s2", 0.5), ("s1", "s2", 0.5)]


def test_index_text(spark):
    rows = [("d", 1, "b", "S", "S", 'say "x"\n£'), ("d", 0, "a", "S", "S", "t")]
    got = chunks.index_text(spark.createDataFrame(rows, chunks.CHUNKS)).first()["index_text"]
    assert got == 'a: "t"\nb: ' + json.dumps('say "x"\n£', ensure_ascii=False)


def test_deep_json(spark):
    deep = '{"a":' * 60 + '"leaf"' + "}" * 60
    got = chunks.leaves(spark.createDataFrame([("d", deep)], "doc_id string, raw string")).collect()
    assert len(got) == 1 and got[0]["source_path"].count(">") == 59


def test_pool_walks_and_numbers_once(spark):
    """What the pool reads was written: no walk is left in its plan, and few exchanges."""
    plan = chunks.pool(spark.createDataFrame([("d1", json.dumps(APP))], "doc_id string, raw string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 0 and plan.count("Exchange ") <= 12


def test_derived_names_beside_sections_of_the_same(spark):
    """A section of the derived chunk's name, or of its initials, numbers it on."""
    app = {"APPLICATION DETAILS": {"Plain English Summary": "We help.", chunks.PLAIN_ANALYSIS: ["one", "two"], "All Fine Again": "x"}}
    df = spark.createDataFrame([("d", json.dumps(app))], "doc_id string, raw string")
    got = chunks.pool(df).orderBy("chunk_pos").collect()
    assert [r["chunk_id"] for r in got] == ["secpes__001", "secpena__001", "secpena__002", "secafa__001", "secpena__003", "secafa2__001"]
    assert [r["chunk_pos"] for r in got] == list(range(6))


def test_names_that_meet_other_initials(spark):
    """A numbered name may be another section's initials; that one goes on to the next number, as sections come."""
    rng = random.Random(4)
    names = ["Aim", "Also", "A 2", "A", "A 2 2", "B", "b 2", "A 22", "2 2", "2", "Alpha Beta", "a b", "a b 2", "!", "?", "x", "a3", "A 3", "Sum 2 3"]
    rows = [("d", n, i) for i, n in enumerate(("Aim", "Also", "A 2"))]
    for d in range(20):
        some = dict.fromkeys(rng.sample(names, rng.randint(3, len(names))) + [f"A{i}" for i in range(rng.randint(0, 5))])
        rows += [(f"d{d}", n, i) for i, n in enumerate(some)]
    want: dict = {}
    for doc, name, _ in rows:  # in order of position
        parts = re.findall("[a-z0-9]+", name.lower())
        base = "sec" + ("".join(p[0] for p in parts) or "x")
        used = {s for (d, _), s in want.items() if d == doc}
        want[doc, name] = next(c for c in (base, *(f"{base}{k}" for k in range(2, 99))) if c not in used)
    got = chunks.slugs(spark.createDataFrame(rows, "doc_id string, parser_section string, pos int")).collect()
    assert {(r.doc_id, r.parser_section): r.slug for r in got} == want and len(got) == len(rows)
    assert [want["d", n] for n in ("Aim", "Also", "A 2")] == ["seca", "seca2", "seca22"]


def test_best_pairs_of_many_sections(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    rows = [(d, i, f"S{i}", " ".join(rng.choice(words[: 40 if i % 7 == 0 else 300]) for _ in range(rng.randint(0, 50)))) for d, n in (("small", 10), ("large", 90)) for i in range(n)]
    rows += [("large", 900, "same", rows[40][3]), ("large", 901, "same again", rows[40][3])]
    df = spark.createDataFrame(rows, "doc_id string, section_pos int, parser_section string, text string")
    for least, top in ((0.18, 8), (0.05, 300)):
        want = []
        for doc in ("small", "large"):
            sets = [(p, n, set(t.split())) for d, p, n, t in rows if d == doc]
            pairs = sorted((-round(len(a & b) / len(a | b), 3), p, q, n, m) for (p, n, a), (q, m, b) in combinations(sets, 2) if a and b)
            want += [(doc, n, m, -s, k + 1) for k, (s, _, _, n, m) in enumerate([x for x in pairs if -x[0] >= least][:top])]
        assert sorted(map(tuple, chunks.overlaps(df, least, top).collect())) == sorted(want)


def test_sections_without_common_words_make_no_pairs(spark):
    word = lambda c: F.translate(F.concat(F.lit(f"{c}xx"), F.col("id").cast("string")), "0123456789", "abcdefghij")
    many = spark.range(5000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("section_pos"), F.col("id").cast("string").alias("parser_section"), F.concat_ws(" ", *map(word, "abcdefgh")).alias("text"))
    sets = many.select("doc_id", "section_pos", chunks.T.overlap_words("text").alias("words"))
    assert chunks.postings(sets).isEmpty() and chunks.overlaps(many).isEmpty()
