"""Text scalars: counts, tokens, readability, duplication, overlap, parsing of small formats."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from .columns import WS, any_of, col, let, py_round, ratio, squeeze, strings, strip

WORD = r"[\p{L}\p{N}_]+"
READ_WORD = r"[A-Za-z][A-Za-z'-]*"

# Common long words that aren't technical terms.
COMMON_LONG_WORDS = (
    "because", "between", "different", "important", "research", "summary",
    "treatment", "patients", "people", "project", "condition", "currently",
)

# Aspects that a lay summary covers, and the words that show it.
COVERAGE = {
    "problem": r"\b(problem|condition|burden|currently|uncertainty|need)\b",
    "objectives": r"\b(aim|objective|will|project|develop|evaluate|identify)\b",
    "methods": r"\b(method|data|dataset|model|interview|review|analysis|study)\b",
    "beneficiaries": r"\b(patient|people|clinician|public|service|nhs)\b",
    "impact": r"\b(benefit|improve|impact|personalised|save|reduce|support)\b",
}

# Marks of structure in a form.
STRUCTURE = {
    "bullets": r"(?m)^\s*(?:[-*•]|\d+[.)])\s+",
    "numbered_headings": r"(?m)^\s*\d+(?:\.\d+)*[.)]?\s+[A-Z][^\n]{3,120}$",
    "table_lines": r"(?imU)\b(year\s+1|year\s+2|year\s+3|total cost|total \(|£)\b",
    "emphasis": r"(?U)(\*\*|__|<b>|</b>|\b[A-Z][A-Z /&-]{8,}\b)",
    "transitions": (
        r"(?iU)\b(however|therefore|furthermore|moreover|in addition|to do this|for example|"
        r"as a result|this will|this project|aligns? with|building on|in phase|phase \d)\b"
    ),
    "objective_links": (
        r"(?iU)\b(aims?|objectives?|research questions?|methods?|workstreams?|work packages?|"
        r"phase \d|project plan|data analysis|impact|dissemination|budget|justification)\b"
    ),
}

# What makes a drawback material, and turns of phrase that say there is none.
CAVEAT = (
    r"(?iU)\b(not explicitly|not explicit|no explicit|not provided|not included|not detailed|"
    r"not fully|less detailed|missing|lacks?|lacking|limited|partial(?:ly)?|"
    r"inferred|implied|could be more|could improve|weak|unclear|caveats?|"
    r"gaps?|limitations?|drawbacks?|however|but)\b"
)
CAVEAT_NOUNS = "(?:gaps?|caveats?|drawbacks?|limitations?|weaknesses)"
NO_CAVEAT = (
    "no significant gaps", "no material gaps", "no gaps",
    "no significant caveats", "no material caveats", "no caveats",
    "no significant drawbacks", "no material drawbacks",
    "no significant limitations", "no material limitations", "no limitations",
    "no weaknesses",
)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text_or_empty(c), F.lit(WORD)), F.lit(0)).cast("long")


def _tokens(c: Column) -> Column:
    """Number of space-separated tokens of a squeezed text."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def normalized_lines(c: Column | str) -> Column:
    """Lines of four tokens or more, white space squeezed, lower-cased."""
    lines = F.transform(F.split(text_or_empty(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.lower(squeeze(x)))
    return F.filter(lines, lambda x: _tokens(x) >= 4)


def split_sentences(c: Column | str) -> Column:
    return F.split(text_or_empty(c), r"(?<=[.!?])\s+|\n+")


def sentence_tokens(c: Column | str) -> Column:
    """Sentences as lower-case letters, digits and spaces, of five tokens or more."""
    bare = F.transform(split_sentences(c), lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9 ]+", "")))
    return F.filter(bare, lambda x: _tokens(F.regexp_replace(x, " +", " ")) >= 5)


def duplication(items: Column) -> Column:
    """Share of items that repeat an earlier one, not rounded."""
    return let(items, lambda a: F.when(F.size(a) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(a)) / F.size(a)))


def duplication_rate(items: Column) -> Column:
    return py_round(duplication(items), 3)


def overlap_words(c: Column | str) -> Column:
    """Distinct lower-case words of three letters a-z or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words, not rounded; 0 if either is empty."""
    def share(n: Column) -> Column:
        a, b, both = n["a"], n["b"], n["both"]
        return F.when((a == 0) | (b == 0), 0.0).otherwise(ratio(both, a + b - both))

    return let(F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("both")), share)


def jaccard_similarity(a: Column, b: Column) -> Column:
    return py_round(let(F.struct(overlap_words(a).alias("a"), overlap_words(b).alias("b")), lambda w: jaccard(w["a"], w["b"])), 3)


def read_sentences(c: Column | str) -> Column:
    return F.filter(F.transform(split_sentences(c), strip), lambda x: x != "")


def read_words(c: Column | str) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(r"(?U)\b" + READ_WORD + r"\b"), F.lit(0))


def syllables(word: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), "[^a-z]", "")
    return let(bare, lambda w: F.when(w == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "e$", ""), F.lit("[aeiouy]+")))))


def syllable_sum(words: Column) -> Column:
    """Syllables of all of read_words, by passes over the joined words: vowel groups, and one for each word without any."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.array_join(words, " ")), "['-]", ""), "e(?= |$)", "")
    return let(text, lambda t: F.regexp_count(t, F.lit("[aeiouy]+")) + F.size(words) - F.regexp_count(t, F.lit("[^aeiouy ]*[aeiouy][^ ]*")))


def _of_counts(sentences: Column, words: Column, syllable_count: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """use(the counts), each counted once; 0 without sentences or words."""
    held = F.struct(sentences.alias("s"), words.alias("w"), syllable_count.alias("y"))
    return let(held, lambda n: F.when((n["s"] > 0) & (n["w"] > 0), use(n["s"], n["w"], n["y"])).otherwise(0.0))


def flesch_kincaid(sentences: Column, words: Column, syllable_count: Column) -> Column:
    """Grade from counts, not rounded; 0 without sentences or words."""
    return _of_counts(sentences, words, syllable_count, lambda s, w, y: 0.39 * (w / s) + 11.8 * (y / w) - 15.59)


def reading_ease(sentences: Column, words: Column, syllable_count: Column) -> Column:
    return _of_counts(sentences, words, syllable_count, lambda s, w, y: 206.835 - 1.015 * (w / s) - 84.6 * (y / w))


def flesch_kincaid_grade(c: Column | str) -> Column:
    return let(read_words(c), lambda w: py_round(flesch_kincaid(F.size(read_sentences(c)).cast("double"), F.size(w).cast("double"), syllable_sum(w).cast("double")), 2))


def flesch_reading_ease(c: Column | str) -> Column:
    return let(read_words(c), lambda w: py_round(reading_ease(F.size(read_sentences(c)).cast("double"), F.size(w).cast("double"), syllable_sum(w).cast("double")), 2))


def technical_terms(c: Column | str) -> Column:
    """Words of eleven letters or more that aren't common, each once, in order."""
    bare = F.transform(read_words(c), lambda w: F.btrim(F.lower(w), F.lit("'")))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 11) & ~w.isin(*COMMON_LONG_WORDS)))


def coverage_hits(c: Column | str) -> Column:
    """Names of the aspects of COVERAGE that a text touches, in their order."""
    return F.filter(F.array(*[F.when(text_or_empty(c).rlike("(?iU)" + p), F.lit(k)) for k, p in COVERAGE.items()]), lambda x: x.isNotNull())


def structure_count(c: Column | str, kind: str) -> Column:
    return F.coalesce(F.regexp_count(text_or_empty(c), F.lit(STRUCTURE[kind])), F.lit(0)).cast("long")


def preview(c: Column | str, limit: int = 500, end: str = "...") -> Column:
    flat = squeeze(text_or_empty(c))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit(end)))


def strip_think(c: Column | str) -> Column:
    return strip(F.regexp_replace(text_or_empty(c), r"(?s)<think>.*?</think>\s*", ""))


def outer_object(c: Column | str) -> Column:
    """From the first { to the last }; the text itself if there is no such pair."""
    found = lambda t: let(F.regexp_extract(t, r"(?s)\{.*\}", 0), lambda x: F.when(x != "", x).otherwise(t))
    return let(text_or_empty(c), lambda t: F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), t).otherwise(found(t)))


def _bare(t: Column) -> Column:
    """A trimmed text without a code fence around it."""
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?[^\n]*\n?", ""), r"```$", ""))).otherwise(t)


def strip_fence(c: Column | str) -> Column:
    """Without a code fence around it."""
    return let(strip(text_or_empty(c)), _bare)


def outer_text(c: Column | str) -> Column:
    """What may be the JSON object in a model's answer."""
    bare = F.startswith(col(c), F.lit("{")) & F.endswith(col(c), F.lit("}")) & ~F.contains(col(c), F.lit("<think>"))
    return F.when(bare, col(c)).otherwise(outer_object(let(strip_think(c), _bare)))  # most are it as they stand


def json_object(c: Column | str) -> Column:
    """The JSON object in a model's answer, or null if there is none."""
    return let(outer_text(c), lambda t: F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), t))


def parse_percent(c: Column | str) -> Column:
    return F.coalesce(strip(F.replace(text_or_empty(c), F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0))


def parse_currency(c: Column | str) -> Column:
    """£1.2m, £30k, £1,234.50; junk is 0."""
    bare = strip(F.regexp_replace(text_or_empty(c), "[£,]", ""))
    unit = F.lower(F.right(bare, F.lit(1)))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    return F.coalesce(F.when(unit.isin("k", "m"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare).try_cast("double") * times, F.lit(0.0))


def keyword_count(c: Column | str, keywords: Sequence[str]) -> Column:
    """Whole-word hits of every keyword, added up; overlapping keywords each count.

    Single words can't overlap each other, so one pass counts them all; phrases each take one.
    """
    t = text_or_empty(c)
    words = [k for k in dict.fromkeys(keywords) if re.fullmatch(r"\w+", k)]
    total = F.regexp_count(t, F.lit(rf"(?iU)\b(?:{'|'.join(words)})\b")) if words else F.lit(0)
    for k in keywords:
        if k in words:
            words.remove(k)  # a word that is named again counts again
        else:
            total = total + F.regexp_count(t, F.lit(rf"(?iU)\b\Q{k}\E\b"))
    return total.cast("long")


def category_amount(c: Column | str, keywords: Sequence[str]) -> Column:
    """The amount that follows the first keyword, in the keywords' order, which has one."""
    found = [F.nullif(F.regexp_extract(text_or_empty(c), rf"(?i){k}[^£]*?(£[\d,]+(?:\.\d+)?[km]?)", 1), F.lit("")) for k in keywords]
    return parse_currency(F.coalesce(*found, F.lit("")))


def normalize_doi(c: Column | str) -> Column:
    return F.lower(strip(F.regexp_replace(strip(c), r"https?://doi\.org/|doi:", "")))


def extract_doi(ids: Column) -> Column:
    """The first of an array of (type, value) that is a DOI by its type or holds one."""
    one = F.transform(ids, lambda x: F.when(F.lower(x["type"]) == "doi", F.nullif(strip(x["value"]), F.lit(""))).otherwise(F.nullif(F.regexp_extract(F.coalesce(x["value"], F.lit("")), r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0), F.lit(""))))
    return F.get(F.filter(one, lambda x: x.isNotNull()), F.lit(0))


def contains_any(c: Column | str, keywords: Sequence[str]) -> Column:
    return any_of(keywords, lambda k: F.contains(F.lower(text_or_empty(c)), k))


def title_hits(titles: Column, keywords: Sequence[str]) -> Column:
    """Titles that hold a keyword; one hit a title."""
    return F.size(F.filter(titles, lambda t: F.exists(strings(*keywords), lambda k: F.contains(F.lower(t), k)))).cast("long")


def recency_weight(year: Column, now: Column | int) -> Column:
    age = (now if isinstance(now, Column) else F.lit(now)) - year
    return F.when(year.isNull(), 0.0).when(age <= 1, 1.0).when(age <= 3, 0.7).when(age <= 5, 0.4).otherwise(0.2)


def json_value(raw: Column) -> Column:
    """A JSON value that may be wrapped as {"value": …}."""
    return F.when(F.btrim(raw).startswith("{"), F.get_json_object(raw, "$.value")).otherwise(raw)


def has_caveat(c: Column | str) -> Column:
    t = F.lower(text_or_empty(c))
    for lead in ("no", "or"):
        t = F.regexp_replace(t, rf"\b{lead}\s+(?:significant|material)?\s*{CAVEAT_NOUNS}\b", "")
    for phrase in NO_CAVEAT:
        t = F.replace(t, F.lit(phrase), F.lit(""))
    return t.rlike(CAVEAT)


def mentions(c: Column, signal: Column) -> Column:
    """Whether a text names a signal id as a word of its own, in either case."""
    mark = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])\Q"), signal, F.lit(r"\E(?![\p{L}\p{N}_])"))
    t = text_or_empty(c)
    # a pattern that varies by row is compiled for every row, so only where the id occurs at all
    return F.when(F.contains(F.lower(t), F.lower(signal)), F.rlike(t, mark)).otherwise(F.lit(False))


def caveat_about(c: Column | str, signal: Column) -> Column:
    """Whether some sentence names the signal and holds a caveat."""
    return F.exists(split_sentences(c), lambda s: mentions(s, signal) & has_caveat(s))


def with_prefix(section: Column, text: Column, limit: int = 220) -> Column:
    """An implication with its section in front, cut to limit characters."""
    t, prefix = strip(text_or_empty(text)), F.concat(section, F.lit(":"))
    return F.substring(F.when(t == "", prefix).when(F.startswith(t, prefix), t).otherwise(F.concat(prefix, F.lit(" "), t)), 1, limit)


def by_position(ids: Column, positions: Column) -> Column:
    """Ids in the order of a map id -> position, unknown ones last, ties as they were."""
    ranked = F.transform(ids, lambda x, i: F.struct(F.coalesce(F.try_element_at(positions, x), F.lit(1_000_000_000)).alias("p"), i.alias("i"), x.alias("id")))
    return F.transform(F.sort_array(ranked), lambda x: x["id"])


def case_and_phase(c: Column | str) -> tuple[Column, Column]:
    """Of id_before or id_after: the id and the phase, both null if the name is neither."""
    p = r"^(.+)_(before|after)$"
    return F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")), F.nullif(F.regexp_extract(col(c), p, 2), F.lit(""))


def first_number(c: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(c), r"[-+]?\d*\.?\d+", 0).try_cast("double")


def role_text(members: Column) -> Column:
    """Roles of a team joined with spaces; empty ones skipped."""
    return F.array_join(F.filter(F.transform(members, lambda m: m["proposed_role"]), lambda r: r.isNotNull() & (r != "")), " ")


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__] + ["WS"]
