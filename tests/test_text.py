import random

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.columns import py_round, squeeze, strip


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_py_round_is_pythons(spark):
    rng = random.Random(3)
    xs = [2.675, 1.005, 0.285, 2.5, 3.5, -2.675, -0.5, 0.125, 0.375, 1e-9, 0.0] + [rng.uniform(-1000, 1000) for _ in range(3000)] + [rng.randrange(100_000) / 1000 for _ in range(3000)]
    for digits in (0, 1, 2, 3, 4):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", py_round(F.col("x"), digits).alias("y")).collect()
        assert all(r["y"] == round(r["x"], digits) for r in got), [(r["x"], r["y"], digits) for r in got if r["y"] != round(r["x"], digits)][:5]


def test_syllables(spark):
    want = {"": 0, "the": 1, "apple": 1, "people": 1, "queue": 1, "banana": 3, "rhythm": 1, "e": 0, "ice": 1, "don't": 1}
    for word, n in want.items():
        got = one(spark, word, T.syllables)
        assert got == (1 if word == "e" else n), word


def test_sentences_and_duplication(spark):
    text = "One two three four five. One two three four five! Six seven.\nOne two three four five"
    assert one(spark, text, T.sentence_tokens) == ["one two three four five"] * 3
    assert one(spark, text, lambda x: T.duplication_rate(T.sentence_tokens(x))) == 0.667
    assert one(spark, "", lambda x: T.duplication_rate(T.sentence_tokens(x))) == 0.0


def test_readability_of_nothing(spark):
    assert one(spark, "", T.flesch_kincaid_grade) == 0.0
    assert one(spark, None, T.flesch_reading_ease) == 0.0
    assert one(spark, "A cat sat. A dog ran.", T.flesch_kincaid_grade) == round(0.39 * 3 + 11.8 * 1 - 15.59, 2)


def test_read_words_are_whole(spark):
    assert one(spark, "don't well-known été abc1 x' -y", T.read_words) == ["don't", "well-known", "x", "y"]


def test_technical_terms_keep_order(spark):
    assert one(spark, "Interoperability because Heterogeneous interoperability", T.technical_terms) == ["interoperability", "heterogeneous"]


def test_jaccard(spark):
    assert one(spark, "The cat sat", lambda x: T.jaccard_similarity(x, F.lit("the cat ran"))) == 0.5
    assert one(spark, "", lambda x: T.jaccard_similarity(x, F.lit("the cat"))) == 0.0


def test_caveats(spark):
    for text, want in {"No significant gaps or limitations.": False, "No gaps or weaknesses": False, "However, fine": True, "The plan lacks detail": True, "rebuttal": False, "": False, "unclear": True}.items():
        assert one(spark, text, T.has_caveat) is want, text
    about = lambda s: (lambda x: T.caveat_about(x, F.lit(s)))
    text = "g.1.a is missing. g.1.b is excellent."
    assert one(spark, text, about("g.1.a")) and not one(spark, text, about("g.1.b")) and not one(spark, "g.1.ab is missing", about("g.1.a"))


def test_currency_percent_amount(spark):
    for text, want in {"£1.2m": 1_200_000.0, "£30k": 30_000.0, "£1,234.50": 1234.5, "junk": 0.0, "": 0.0, None: 0.0}.items():
        assert one(spark, text, T.parse_currency) == want
    assert one(spark, " 10% ", T.parse_percent) == 10.0
    assert one(spark, "ppi is £3k; engagement £9k", lambda x: T.category_amount(x, ["engagement", "ppi"])) == 9000.0


def test_literal_pound_boundary(spark):
    """A pound sign counts only between word characters, and "total (" only before one."""
    assert one(spark, "a£b £5 total (x total ( y year 1", lambda x: T.structure_count(x, "table_lines")) == 3


def test_structure_counts(spark):
    text = "- one\n2. Two things here\n1.2 Heading Of Things\n**bold** FULL CAPITALS HERE\nHowever, in phase 2 the aims"
    counts = {k: one(spark, text, lambda x, k=k: T.structure_count(x, k)) for k in T.STRUCTURE}
    assert counts["bullets"] == 2 and counts["numbered_headings"] == 2 and counts["emphasis"] == 3 and counts["transitions"] >= 2 and counts["objective_links"] == 2


def test_json_object(spark):
    for raw, want in {'<think>{}</think>\n{"a":1}': '{"a":1}', '```json\n{"a":1}\n```': '{"a":1}', 'x {"a":1} y': '{"a":1}', "nothing": None, '{"a":': None, "": None, None: None}.items():
        assert one(spark, raw, T.json_object) == want, raw


def test_doi(spark):
    assert one(spark, " https://doi.org/10.1000/ABC ", T.normalize_doi) == "10.1000/abc"
    ids = F.array(F.struct(F.lit("isbn").alias("type"), F.lit("1").alias("value")), F.struct(F.lit("url").alias("type"), F.lit("see 10.1234/x.y").alias("value")))
    assert one(spark, "", lambda x: T.extract_doi(ids)) == "10.1234/x.y"


def test_prefix_and_order(spark):
    assert one(spark, " a ", lambda x: T.with_prefix(F.lit("S"), x)) == "S: a"
    assert one(spark, "S: a", lambda x: T.with_prefix(F.lit("S"), x)) == "S: a"
    assert one(spark, "", lambda x: T.with_prefix(F.lit("S"), x)) == "S:"
    assert len(one(spark, "b" * 400, lambda x: T.with_prefix(F.lit("S"), x))) == 220
    places = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(0))
    assert one(spark, ["z", "a", "b", "y"], lambda x: T.by_position(x, places), "array<string>") == ["b", "a", "z", "y"]


def test_white_space(spark):
    assert one(spark, "   a\t\n b ", squeeze) == "a b"
    assert one(spark, "\n a b \n", strip) == "a b"
    assert one(spark, "a  b" * 300, lambda x: F.length(T.preview(x, 500))) == 503


def test_recency(spark):
    now = [(2026, 1.0), (2025, 1.0), (2023, 0.7), (2021, 0.4), (2000, 0.2), (None, 0.0)]
    for year, want in now:
        assert one(spark, year, lambda x: T.recency_weight(x, 2026), "int") == want


def test_keywords_count_alike_together_and_alone(spark):
    """One pass over single words counts what a pass for each counts; phrases overlap words."""
    rng = random.Random(2)
    keys = ["lead", "leader", "co-lead", "first author", "author", "£", "pi", "é", "lead", "a_b"]
    texts = [" ".join(rng.choice(["lead", "Leader", "LEADING", "co-lead", "first author", "authors", "£ 5", "PI", "pie", "é", "a_b", "x-pi."]) for _ in range(30)) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    got = df.select(T.keyword_count("t", keys).alias("n"), *[T.keyword_count("t", [k]).alias(f"k{i}") for i, k in enumerate(keys)]).collect()
    assert all(r["n"] == sum(r[f"k{i}"] for i in range(len(keys))) for r in got) and sum(r["n"] for r in got) > 100


def test_values_are_named_once(spark):
    """A rounded figure names its text no more than a few times, wherever the planner moves it: each name is an evaluation."""
    df = spark.range(1).select(F.concat(F.lit("probe "), F.col("id").cast("string")).alias("t"))
    named = lambda c: df.select(c.alias("x")).where("x >= 0")._jdf.queryExecution().optimizedPlan().toString().count("probe")
    assert named(py_round(F.sqrt(F.length("t")), 2)) <= 2
    for c in (T.flesch_kincaid_grade("t"), T.flesch_reading_ease("t"), T.jaccard_similarity(F.col("t"), F.lit("a probe"))):
        assert named(c) <= 6
