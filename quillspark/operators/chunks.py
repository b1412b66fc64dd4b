"""Nested application JSON to ordered, identified text chunks.

The tree walk, whose depth the data decides, is one Arrow-batched function; cutting,
naming and the derived chunks are column expressions and grouped aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import ship, stored
from ..functions import text as T
from ..functions.columns import let, py_round, strip

MAX_CHARS = 1200
DETAILS, BUDGET = "APPLICATION DETAILS", "SUMMARY BUDGET"
CONTEXT = "Application Context"
FORM_ANALYSIS = "Application Form Analysis"
PLAIN_ANALYSIS = "Plain English NLP Analysis"
PLAIN_SECTIONS = ("Plain English Summary of Research", "Plain English Summary")
PLAN_SECTION = "Detailed Research Plan"
OVERLAP_AT_LEAST, OVERLAP_TOP = 0.18, 8

CHUNKS = "doc_id string, chunk_pos int, chunk_id string, parser_section string, source_path string, text string"


def _leaf_text(value: object) -> str:
    return "" if value is None else value.strip() if isinstance(value, str) else str(value)


def _below(value: object, path: str) -> Iterator[tuple[str, str]]:
    """(path, text) of the leaves that hold text, in document order; an explicit stack, so any depth."""
    todo = [(path, value)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path} > {k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(f"{path} > [{i}]", v) for i, v in reversed(list(enumerate(value)))]
        elif text := _leaf_text(value):
            yield path, text


def walk(application: dict) -> Iterator[tuple[str, str, str]]:
    """(section, path, text) of every leaf. Details and budgets have sections; the rest is context."""
    for root, value in application.items():
        if root == DETAILS and isinstance(value, dict):
            branches = [(name, f"{root} > {name}", v) for name, v in value.items()]
        elif root == BUDGET:
            branches = [(root, root, value)]
        elif isinstance(value, dict):
            branches = [(BUDGET if name == BUDGET else CONTEXT, f"{root} > {name}", v) for name, v in value.items()]
        else:
            branches = [(CONTEXT, root, value)]
        for section, path, branch in branches:
            for p, text in _below(branch, path):
                yield section, p, text


def leaves(applications: DataFrame, id_col: str = "doc_id", json_col: str = "raw") -> DataFrame:
    """(doc_id, leaf_pos, parser_section, source_path, text); raw that isn't a JSON object gives no rows."""
    ship(applications.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, raw in zip(pdf["doc_id"], pdf["raw"], strict=True):
                try:
                    tree = json.loads(raw)
                except (TypeError, ValueError):
                    continue
                if isinstance(tree, dict):
                    out += [(doc, i, *x) for i, x in enumerate(walk(tree))]
            yield pd.DataFrame(out, columns=["doc_id", "leaf_pos", "parser_section", "source_path", "text"])

    return applications.select(F.col(id_col).cast("string").alias("doc_id"), F.col(json_col).alias("raw")).mapInPandas(run, "doc_id string, leaf_pos int, parser_section string, source_path string, text string")


def slices(text: Column, size: int) -> Column:
    """Consecutive pieces of size characters, each trimmed."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size))))


def split_text(text: Column, size: int = MAX_CHARS) -> Column:
    """Pieces of a text: whole if short, fixed slices of a lone paragraph, else a piece a paragraph, long ones sliced."""

    def cut(t: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n+"), strip), lambda p: p != "")
        each = F.filter(F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(slices(p, size)))), lambda p: p != "")
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).when(F.size(paragraphs) <= 1, slices(t, size)).otherwise(each)

    return let(strip(T.text_or_empty(text)), cut)


def initials(section: Column) -> Column:
    """sec and the first letters of a section's words, or x."""
    parts = F.regexp_extract_all(F.lower(section), F.lit("[a-z0-9]+"), F.lit(0))
    joined = F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")
    return F.concat(F.lit("sec"), F.when(joined == "", F.lit("x")).otherwise(joined))


def _letter(i: Column) -> Column:
    """The character i places after a; past z it goes on through Unicode."""
    code = i + 97
    return F.when(code < 128, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _allocated(named: Column) -> Column:
    """Sections (pos, parser_section, base, nth) of one root in order -> (parser_section, slug): base, or base and the least number from 2 on that no section before has.

    nth counts the sections of the same base so far. Those before hold the first nth - 1 names of the base at least,
    so the search begins there and ends after as many names as sections of other bases can hold.
    """
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<parser_section:string,slug:string>>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        others = F.size(F.filter(named, lambda y: y["base"] != x["base"]))
        numbers = F.sequence(F.greatest(x["nth"], F.lit(2)), F.greatest(x["nth"], F.lit(2)) + others)
        free = lambda: F.get(F.filter(F.transform(numbers, lambda k: F.concat(x["base"], k.cast("string"))), lambda c: ~F.array_contains(held["used"], c)), F.lit(0))
        slug = F.when(F.array_contains(held["used"], x["base"]), free()).otherwise(x["base"])
        return let(slug, lambda c: F.struct(F.array_append(held["used"], c).alias("used"), F.array_append(held["out"], F.struct(x["parser_section"].alias("parser_section"), c.alias("slug"))).alias("out")))

    return F.aggregate(named, start, step, lambda held: held["out"])


def slugs(sections: DataFrame) -> DataFrame:
    """(doc_id, parser_section, pos) -> with slug: initials, then a number where another section has that name already.

    Names go out in order of pos. A numbered name may be the initials of another section ("A 2"), which then goes on
    to the next. Only sections whose initials are alike but for digits at the end can meet, so a document is cut into
    these; those of one kind of initials alone are numbered without a fold.
    """
    base = sections.withColumn("base", initials(F.col("parser_section")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("pos"))
    named = base.withColumn("nth", nth).withColumn("root", F.regexp_replace("base", "[0-9]+$", ""))
    kinds = F.size(F.collect_set("base").over(Window.partitionBy("doc_id", "root")))
    named = named.withColumn("kinds", kinds)
    alone = named.where("kinds = 1").withColumn("slug", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.col("nth").cast("string"))))
    one = F.struct("pos", "parser_section", "base", "nth")
    meeting = named.where("kinds > 1").groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(one)).alias("all"))
    given = meeting.select("doc_id", F.explode(_allocated(F.col("all"))).alias("x")).select("doc_id", "x.parser_section", "x.slug")
    met = named.where("kinds > 1").join(given, ["doc_id", "parser_section"])
    keep = [*sections.columns, "slug"]
    return alone.select(keep).unionByName(met.select(keep))


def named_sections(entries: DataFrame) -> DataFrame:
    """(doc_id, parser_section, n, slug): the sections of entries, how many each has."""
    return slugs(entries.groupBy("doc_id", "parser_section").agg(F.min("leaf_pos").alias("pos"), F.count("*").alias("n"))).drop("pos")


def identify(entries: DataFrame, size: int = MAX_CHARS, sections: DataFrame | None = None) -> DataFrame:
    """Chunks of entries (doc_id, leaf_pos, parser_section, source_path, text, whole): cut, named, numbered. sections: named_sections() if it is there already."""
    sections = named_sections(entries) if sections is None else sections
    named = entries.join(sections.drop("n"), ["doc_id", "parser_section"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("leaf_pos"))
    base = F.format_string("%s__%03d", F.col("slug"), nth)
    cut = named.withColumn("base", base).withColumn("pieces", F.when(F.col("whole"), F.array(strip("text"))).otherwise(split_text(F.col("text"), size)))
    rows = cut.select("doc_id", "leaf_pos", "parser_section", "source_path", "base", F.size("pieces").alias("n"), F.posexplode("pieces").alias("i", "text"))
    chunk_id = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), _letter(F.col("i"))))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("leaf_pos", "i")) - 1
    return rows.select("doc_id", pos.alias("chunk_pos"), chunk_id.alias("chunk_id"), "parser_section", "source_path", "text")


def entries(leaf: DataFrame) -> DataFrame:
    """Leaves with the context leaves of a document folded to one entry, which comes last and stays whole."""
    own = leaf.where(F.col("parser_section") != CONTEXT).select("doc_id", "leaf_pos", "parser_section", "source_path", "text", F.lit(False).alias("whole"))
    part = F.struct("leaf_pos", F.concat("source_path", F.lit(":\n"), "text").alias("t"))
    context = leaf.where(F.col("parser_section") == CONTEXT).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))
    context = context.select("doc_id", F.lit(2_000_000_000).alias("leaf_pos"), F.lit(CONTEXT).alias("parser_section"), F.lit(CONTEXT).alias("source_path"), "text", F.lit(True).alias("whole"))
    return own.unionByName(context)


def section_texts(chunk: DataFrame) -> DataFrame:
    """(doc_id, section_pos, parser_section, text): chunks of a section joined by blank lines, in order."""
    part = F.struct("chunk_pos", "text")
    return chunk.groupBy("doc_id", "parser_section").agg(F.min("chunk_pos").alias("section_pos"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("text"))


#: Documents of up to this many sections have all their pairs scored; larger ones go through the index.
ALL_PAIRS = 64
#: Words in up to this many sections make the first pairs, which tell how good the best are.
RARE = 4


def _scored(pairs: DataFrame, words: DataFrame, at_least: float) -> DataFrame:
    """Pairs (doc_id, pos_a, pos_b) with names and score, of at_least or more."""
    a, b = (words.select("doc_id", F.col("section_pos").alias(f"pos_{x}"), F.col("parser_section").alias(f"section_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    both = pairs.join(a, ["doc_id", "pos_a"]).join(b, ["doc_id", "pos_b"])
    score = py_round(T.jaccard(F.col("words_a"), F.col("words_b")), 3)
    return both.select("doc_id", "pos_a", "pos_b", "section_a", "section_b", score.alias("score")).where(F.col("score") >= at_least)


def _best(scored: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos_a", "pos_b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def postings(words: DataFrame) -> DataFrame:
    """(doc_id, word, df, pos, n, left): the words that sections of a document share.

    n is the size of a section's set, left how many of its words, the rarest first, come from this one on. So two sets
    whose first common word this is have the lesser left in common at most.
    """
    index = words.select("doc_id", F.col("section_pos").alias("pos"), F.size("words").alias("n"), F.explode("words").alias("word"))
    shared = index.groupBy("doc_id", "word").agg(F.count("*").alias("df")).where("df > 1")
    rows = index.join(shared, ["doc_id", "word"])
    listed = rows.groupBy("doc_id", "pos", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("all"))
    return listed.select("doc_id", "pos", "n", F.size("all").alias("shared"), F.posexplode("all").alias("i", "x")).select("doc_id", "x.word", "x.df", "pos", "n", (F.col("shared") - F.col("i")).alias("left"))


def candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, pos_a, pos_b) of postings with least (a score), that can reach it: by size, and by what is left from the first common word on."""
    t = F.col("least")
    a, b = (rows.where(F.col("left") >= t * F.col("n")).select("doc_id", "word", "least", *[F.col(c).alias(f"{c}_{x}") for c in ("pos", "n", "left")]) for x in "ab")
    both = a.join(b.drop("least"), ["doc_id", "word"]).where("pos_a < pos_b")
    sized = both.where(F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b"))
    return sized.where(F.least("left_a", "left_b") * (1 + t) >= t * (F.col("n_a") + F.col("n_b"))).select("doc_id", "pos_a", "pos_b").distinct()


def _indexed(words: DataFrame, at_least: float, top: int) -> DataFrame:
    """The best pairs of large documents: the top-th score of pairs that share a rare word bounds what is looked for."""
    rows = stored(postings(words), "overlap-postings")
    low = F.lit(at_least - 0.000501)  # scores are rounded
    first = _best(_scored(candidates(rows.where(F.col("df") <= RARE).withColumn("least", low)), words, at_least), top)
    reached = first.where(F.col("rank") == top).select("doc_id", (F.col("score") - 0.000501).alias("reached"))
    bounded = rows.join(reached, "doc_id", "left").withColumn("least", F.greatest(F.coalesce("reached", low), low)).drop("reached")
    return _best(_scored(candidates(bounded), words, at_least), top)


def overlaps(sections: DataFrame, at_least: float = OVERLAP_AT_LEAST, top: int = OVERLAP_TOP) -> DataFrame:
    """(doc_id, section_a, section_b, score, rank): word overlap of the sections of a document, the best first. at_least is over 0.

    Word sets are computed once a section. A large document's pairs come from an index of its words, spread by
    document and word; that there is one is looked up first, so the plan of others stays short.
    """
    words = sections.select("doc_id", "section_pos", "parser_section", T.overlap_words("text").alias("words"))
    large = sections.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > ALL_PAIRS).select("doc_id")
    out = ["doc_id", "section_a", "section_b", "score", "rank"]
    if large.isEmpty():
        return _best(_all_pairs(words, at_least), top).select(out)
    words, large = stored(words, "overlap-words"), stored(large, "overlap-large")
    few, many = _all_pairs(words.join(large, "doc_id", "left_anti"), at_least), words.join(large, "doc_id", "left_semi")
    return _best(few, top).select(out).unionByName(_indexed(many, at_least, top).select(out))


def _all_pairs(words: DataFrame, at_least: float) -> DataFrame:
    a, b = (words.select("doc_id", F.col("section_pos").alias(f"pos_{x}"), F.col("parser_section").alias(f"section_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    score = py_round(T.jaccard(F.col("words_a"), F.col("words_b")), 3)
    return a.join(b, "doc_id").where("pos_a < pos_b").withColumn("score", score).where(F.col("score") >= at_least)


def _number(x: Column) -> Column:
    """A double as Python prints it, for the magnitudes that occur here."""
    return x.cast("string")


def _listed(a: Column) -> Column:
    """An array of strings as Python prints a list."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.when(F.contains(x, F.lit("'")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), x, F.lit("'")))), ", "), F.lit("]"))


def plain_metrics(sections: DataFrame) -> DataFrame:
    """One row a document with a plain summary: its figures."""
    pick = lambda name: F.max(F.when(F.col("parser_section") == name, F.col("text")))
    doc = sections.groupBy("doc_id").agg(pick(PLAIN_SECTIONS[0]).alias("s0"), pick(PLAIN_SECTIONS[1]).alias("s1"), pick(PLAN_SECTION).alias("plan"))
    doc = doc.select("doc_id", F.when(F.col("s0").isNotNull(), F.lit(PLAIN_SECTIONS[0])).otherwise(F.lit(PLAIN_SECTIONS[1])).alias("source_section"), F.coalesce("s0", "s1").alias("text"), "plan").where(strip(F.col("text")) != "")
    doc = doc.select("*", T.read_words("text").alias("words"), F.transform(T.read_sentences("text"), lambda s: F.size(T.read_words(s))).alias("lengths"), T.technical_terms("text").alias("terms"))
    n, k = F.size("words"), F.size("lengths")
    return doc.select(
        "doc_id",
        "source_section",
        n.alias("word_count"),
        k.alias("sentence_count"),
        py_round(F.coalesce(F.try_divide(F.aggregate("lengths", F.lit(0), lambda a, x: a + x), k), F.lit(0.0)), 2).alias("avg_sentence_length"),
        py_round(F.coalesce(F.try_divide(F.size(F.filter("lengths", lambda x: x >= 30)), k), F.lit(0.0)), 3).alias("long_sentence_ratio"),
        T.flesch_kincaid_grade("text").alias("fk_grade"),
        T.flesch_reading_ease("text").alias("reading_ease"),
        py_round(F.coalesce(F.try_divide(F.size("terms"), n) * 100, F.lit(0.0)), 2).alias("jargon_density"),
        "terms",
        F.when(F.coalesce("plan", F.lit("")) == "", 0.0).otherwise(T.jaccard_similarity(F.col("text"), F.col("plan"))).alias("alignment"),
        T.coverage_hits("text").alias("coverage"),
    )


def plain_block(metrics: DataFrame) -> DataFrame:
    """(doc_id, text): the figures as the text of a derived chunk."""
    c = F.col
    # The wording of the derived chunk.
    lines = [
        F.lit("Plain English Summary NLP analysis derived from parser output."),
        F.lit("Use these metrics as supporting evidence for pr.1, but also read the raw Plain English Summary and Detailed Research Plan in application_text. Do not claim readability, jargon, alignment, or sentence coherence evidence is missing solely because Stage 1 did not provide NLP/coherence findings."),
        F.lit(""),
        F.lit("Readability and sentence structure metrics:"),
        F.concat(F.lit("- source_section="), c("source_section")),
        F.concat(F.lit("- word_count="), c("word_count").cast("string")),
        F.concat(F.lit("- sentence_count="), c("sentence_count").cast("string")),
        F.concat(F.lit("- avg_sentence_length_words="), _number(c("avg_sentence_length"))),
        F.concat(F.lit("- long_sentence_ratio_30_words="), _number(c("long_sentence_ratio"))),
        F.concat(F.lit("- flesch_kincaid_grade_estimate="), _number(c("fk_grade"))),
        F.concat(F.lit("- flesch_reading_ease_estimate="), _number(c("reading_ease"))),
        F.lit(""),
        F.lit("Jargon proxy metrics:"),
        F.concat(F.lit("- unexplained_jargon_proxy_density_pct="), _number(c("jargon_density"))),
        F.concat(F.lit("- technical_terms_sample="), _listed(F.slice("terms", 1, 12))),
        F.lit("- Jargon proxy is based on long/difficult-looking terms; final scoring must still judge whether terms are explained clearly in the summary text."),
        F.lit(""),
        F.lit("Alignment and content coverage metrics:"),
        F.concat(F.lit("- lexical_overlap_with_detailed_research_plan="), _number(c("alignment"))),
        F.concat(F.lit("- lay_summary_coverage_hits="), _listed(c("coverage"))),
        F.lit("- Alignment metric is lexical only; final scoring must compare the actual plain-English claims with the detailed proposal content."),
    ]
    return metrics.select("doc_id", F.concat_ws("\n", *lines).alias("text"))


def form_metrics(sections: DataFrame) -> DataFrame:
    """One row a document: counts of structure over all its sections, duplication, words by section."""
    rows = sections.where(strip(F.col("text")) != "")
    part = F.struct("section_pos", "parser_section", "text")
    doc = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("s"))
    whole = F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")
    free = F.array_join(F.transform(F.filter("s", lambda x: ~F.contains(F.lower(x["parser_section"]), F.lit("budget"))), lambda x: x["text"]), "\n\n")
    doc = doc.select("doc_id", "s", whole.alias("all_text"), F.when(free == "", whole).otherwise(free).alias("free_text"))
    return doc.select(
        "doc_id",
        F.transform("s", lambda x: F.struct(x["parser_section"].alias("section"), T.word_count(x["text"]).alias("words"))).alias("sections"),
        *[T.structure_count("all_text", k).alias(k) for k in T.STRUCTURE],
        T.duplication_rate(T.sentence_tokens("free_text")).alias("sentence_duplication"),
        T.duplication_rate(T.normalized_lines("all_text")).alias("line_duplication"),
    )


def form_block(metrics: DataFrame, overlap: DataFrame) -> DataFrame:
    """(doc_id, text): the form's figures as the text of a derived chunk."""
    line = F.concat(F.lit("- "), "section_a", F.lit(" <-> "), "section_b", F.lit(": lexical_overlap="), _number(F.col("score")))
    best = overlap.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]).alias("lines"))
    c = F.col
    # The wording of the derived chunk.
    none = F.array(F.lit("- No high cross-section lexical overlap detected at threshold 0.18."))
    parts = F.flatten(
        F.array(
            F.array(F.lit("Application form structural analysis derived from parser output."), F.lit("Use this single derived chunk as evidence for Application Form criteria af.*."), F.lit(""), F.lit("Section coverage and hierarchy:")),
            F.transform("sections", lambda s: F.concat(F.lit("- "), s["section"], F.lit(": words="), s["words"].cast("string"))),
            F.array(
                F.lit(""),
                F.lit("Formatting and structure indicators:"),
                F.concat(F.lit("- parser_sections_detected="), F.size("sections").cast("string")),
                F.concat(F.lit("- bullet_or_numbered_list_markers="), c("bullets").cast("string")),
                F.concat(F.lit("- numbered_heading_like_lines="), c("numbered_headings").cast("string")),
                F.concat(F.lit("- table_like_budget_lines="), c("table_lines").cast("string")),
                F.concat(F.lit("- extracted_emphasis_markers="), c("emphasis").cast("string")),
                F.lit("- Parser limitation: bold/emphasis may be lost during text extraction; use extracted headings, section labels, list markers, and table structure as the available evidence."),
                F.lit(""),
                F.lit("Duplication and repetition indicators:"),
                F.concat(F.lit("- duplicate_sentence_rate_excluding_budget="), _number(c("sentence_duplication"))),
                F.concat(F.lit("- repeated_line_rate="), _number(c("line_duplication"))),
            ),
            F.coalesce("lines", none),
            F.array(
                F.lit(""),
                F.lit("Logical flow and coherence indicators:"),
                F.concat(F.lit("- transition_phrase_count="), c("transitions").cast("string")),
                F.concat(F.lit("- objective_method_budget_link_terms="), c("objective_links").cast("string")),
                F.lit("- Section order moves from applicant/context, plain summary and abstract, research plan, PPI, training/support, and budget where those sections are present."),
            ),
        )
    )
    return metrics.join(best, "doc_id", "left").select("doc_id", F.array_join(parts, "\n").alias("text"))


def _derived(blocks: DataFrame, section: str, sections: DataFrame, chunk: DataFrame) -> DataFrame:
    """Chunks of blocks (doc_id, text), whole, after those that a document has: named as identify() would, from counts of its sections."""
    base = initials(F.lit(section))
    own = F.max(F.when(F.col("parser_section") == section, F.struct("slug", "n")))
    counts = sections.groupBy("doc_id").agg(F.count_if(initials(F.col("parser_section")) == base).alias("same"), own.alias("own"))
    last = chunk.groupBy("doc_id").agg(F.max("chunk_pos").alias("last"))
    rows = blocks.join(counts, "doc_id").join(last, "doc_id")
    slug = F.coalesce(F.col("own.slug"), F.when(F.col("same") == 0, base).otherwise(F.concat(base, (F.col("same") + 1).cast("string"))))
    chunk_id = F.format_string("%s__%03d", slug, F.coalesce(F.col("own.n"), F.lit(0)) + 1)
    return rows.select("doc_id", (F.col("last") + 1).alias("chunk_pos"), chunk_id.alias("chunk_id"), F.lit(section).alias("parser_section"), F.lit(section).alias("source_path"), strip("text").alias("text"))


def pool(applications: DataFrame, id_col: str = "doc_id", json_col: str = "raw", size: int = MAX_CHARS) -> DataFrame:
    """Chunks of every application, the derived ones last.

    The walk and the cutting are done once and written; derived chunks are appended to what was written.
    """
    base = stored(entries(leaves(applications, id_col, json_col)), "entries")
    sections = stored(named_sections(base), "sections")
    chunk = stored(identify(base, size, sections), "chunks")
    plain = stored(_derived(plain_block(plain_metrics(section_texts(chunk))), PLAIN_ANALYSIS, sections, chunk), "plain-analysis")
    chunk = chunk.unionByName(plain)
    texts = stored(section_texts(chunk), "section-texts")
    form = _derived(form_block(form_metrics(texts), overlaps(texts)), FORM_ANALYSIS, sections, chunk)
    return chunk.unionByName(form)


def index_text(chunk: DataFrame) -> DataFrame:
    """(doc_id, index_text): a line a chunk, its id and its text as a JSON string."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    line = F.struct("chunk_pos", F.concat("chunk_id", F.lit(": "), quoted).alias("t"))
    return chunk.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n").alias("index_text"))


def section_ids(chunk: DataFrame) -> DataFrame:
    """(doc_id, parser_section, chunk_ids): ids of a section in order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("chunk_pos", "chunk_id"))), lambda x: x["chunk_id"])
    return chunk.groupBy("doc_id", "parser_section").agg(ids.alias("chunk_ids"))
