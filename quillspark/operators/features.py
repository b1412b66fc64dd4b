"""Features of applications: sentences, dependency depth, coherence, team, budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.columns import any_of, py_round, ratio, squeeze, strip

# Sections whose text is analysed, in order.
ANALYSED_SECTIONS = (
    "Scientific Abstract", "Plain English Summary of Research", "Plain English Summary", "Detailed Research Plan",
    "Patient & Public Involvement", "Changes from Previous Stage", "Working with People and Communities Summary",
)

# Words that tell of experience, by kind.
PUBLICATION = (
    "publication", "publications", "published", "paper", "papers",
    "journal", "authored", "co-authored", "first author", "citation",
    "citations", "cited", "peer-reviewed",
)
GRANT = (
    "grant", "grants", "funding", "funded", "award", "awarded",
    "£", "nihr", "mrc", "wellcome", "ukri", "esrc", "epsrc",
    "portfolio", "principal investigator", "pi", "co-i",
)
LEADERSHIP = (
    "lead", "leader", "leading", "led", "director", "chair",
    "head", "chief", "principal", "senior", "professor",
    "established", "founded", "built", "developed",
)
MENTORSHIP = (
    "mentor", "mentoring", "mentored", "supervise", "supervised",
    "supervision", "supervisor", "phd student", "doctoral",
    "postdoc", "early career", "training",
)
CLINICAL = (
    "clinical", "clinician", "consultant", "practitioner",
    "nhs", "patient", "practice", "hospital", "gp", "nurse",
)
SENIOR_TITLES = ("professor", "prof", "director", "head", "chief", "senior")
CLINICAL_ROLES = ("consultant", "clinician", "gp", "nurse", "practitioner")
TRAJECTORY = (
    "career", "trajectory", "vision", "long-term", "future",
    "aspiration", "goal", "develop", "progression", "pathway",
)
# Words of budget categories.
PPI = ("ppi", "ppie", "public involvement", "patient involvement", "lived experience", "co-production", "engagement")
CAPACITY = ("phd", "doctoral", "studentship", "fellowship", "training", "capacity building", "early career", "research associate")
EQUIPMENT = ("equipment", "device", "devices", "hardware", "software", "tablet", "laptop", "kit", "consumable", "consumables")
STAFF = ("staff", "salary", "salaries", "fte", "researcher", "coordinator", "manager", "administrator")

RESUBMITTED = "Has this application been previously submitted to this or any other funding body?"
PERSON = "struct<`Full Name`:string,Organisation:string,Department:string,`Proposed Role`:string,ORCID:string,`% FTE Commitment`:string>"


def sections(applications: DataFrame, names: tuple[str, ...] = ANALYSED_SECTIONS) -> DataFrame:
    """(doc_id, section_pos, section, text) of the named sections of (doc_id, raw) that hold text."""
    details = F.from_json(F.get_json_object("raw", "$['APPLICATION DETAILS']"), "map<string,string>")
    rows = applications.select("doc_id", details.alias("m"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])
    rows = rows.select("doc_id", "m", F.explode(wanted).alias("w"))
    return rows.select("doc_id", F.col("w.i").alias("section_pos"), F.col("w.n").alias("section"), strip(F.try_element_at("m", F.col("w.n"))).alias("text")).where("text <> ''")


def long_leaves(leaf: DataFrame, more_than: int = 30) -> DataFrame:
    """Leaves of any section whose trimmed text is longer: the whole-document variant."""
    return leaf.where(F.length(strip("text")) > more_than).select("doc_id", F.col("leaf_pos").alias("section_pos"), F.col("parser_section").alias("section"), strip("text").alias("text"))


def merged(rows: DataFrame) -> DataFrame:
    """(doc_id, text): sections joined with spaces, in order."""
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_pos", "text"))), lambda x: x["text"]), " ").alias("text"))


# Abbreviations whose full stop belongs to them, in any case of their first letter.
ABBREVIATIONS = (
    "adm", "al", "approx", "bros", "ca", "cf", "co", "corp", "dept", "dr", "ed", "eds", "e.g", "eq", "est", "etc",
    "fig", "figs", "gen", "gov", "i.e", "inc", "jr", "lt", "ltd", "messrs", "mr", "mrs", "ms", "mt", "no", "nos",
    "p.m", "a.m", "ph.d", "pp", "prof", "ref", "refs", "rep", "rev", "sen", "sr", "st", "v.s", "viz", "vol", "vs",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
# Abbreviations that are words as well, or stand at the end of a sentence as often as within one.
NO_STOP_AT_END = ("al", "co", "etc", "inc", "ltd", "no", "nos", "mar", "sen", "est", "ed", "a.m", "p.m", "ca", "ms", "gen", "rep")
# Marks that end a sentence beside the full stop.
ENDS = "!?։؟۔。！？｡"
#: Stands for a full stop that ends nothing, and for a sentence's end.
_HELD, _CUT = "\u0002", "\u0001"


def abbreviations() -> tuple[str, str]:
    """Patterns of those that never end a sentence, and of those that may."""
    either = lambda some: "|".join(f"[{a[0]}{a[0].upper()}]{re.escape(a[1:])}" for a in sorted(some, key=lambda a: (-len(a), a)))
    return either(set(ABBREVIATIONS) - set(NO_STOP_AT_END)), either(NO_STOP_AT_END)


def _held_stops(c: Column) -> Column:
    """Full stops of abbreviations and of single letters (initials, list marks, "U.S.") put aside."""
    first, last = abbreviations()
    before = r"(?<![\p{L}\p{N}.])"
    c = F.regexp_replace(c, rf"{before}({first})\.", f"$1{_HELD}")
    # these end a sentence too: held only where a figure or a small letter goes on
    c = F.regexp_replace(c, rf"{before}({last})\.(?= [\p{{Ll}}\p{{N}}])", f"$1{_HELD}")
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}.])([\p{L}])\.(?!\.)", f"$1{_HELD}")


def sentences(c: Column | str) -> Column:
    """Sentences of a text, white space squeezed.

    A token ends a sentence if it is one of ENDS at the end of a word, or a full stop: at the end of a word after a
    small letter, a figure, a closing mark or two capitals; or between a small letter and a capital. Stops of
    abbreviations, of initials, inside numbers and in rows of dots end nothing. The next sentence begins with the next
    token that is no punctuation, so quotes and brackets that follow stay with the one before. Null gives none.
    """
    text = _held_stops(squeeze(T.text_or_empty(c)))
    last = r"(?=\p{P}*(?: |$))"
    stop = rf"(?<!\.)\.(?!\.)(?:(?<=[\p{{Ll}}\p{{Lo}}\p{{N}}\p{{Pe}}\p{{Pf}}\p{{M}}%²°\"'”’\u0002]\.)|(?<=\p{{Lu}}\p{{Lu}}\.)){last}"
    between = r"(?<=[\p{Ll}\"'”’])\.(?=[\p{Lu}“‘])"
    after = r"(?:[\p{P}&&[^-]]|-(?![\p{L}\p{N}])| )*"
    marked = F.regexp_replace(text, rf"((?:{stop}|{between}|[{ENDS}]{last}){after})", f"$1{_CUT}")
    parts = F.transform(F.split(marked, _CUT), lambda s: F.translate(F.btrim(s), _HELD, "."))
    return F.filter(parts, lambda s: s != "")


def sentence_metrics(rows: DataFrame) -> DataFrame:
    """(doc_id, total_sentences, avg_sentence_length, long_sentence_ratio) of (doc_id, text)."""
    lengths = rows.select("doc_id", F.transform(sentences("text"), lambda s: F.size(F.split(s, " "))).alias("n"))
    total = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    return lengths.select("doc_id", F.size("n").cast("long").alias("total_sentences"), py_round(ratio(total, F.size("n")), 2).alias("avg_sentence_length"), py_round(ratio(F.size(F.filter("n", lambda x: x >= 30)), F.size("n")), 4).alias("long_sentence_ratio"))


def plain_english(rows: DataFrame) -> DataFrame:
    """(doc_id, flesch_kincaid_grade, jargon_count, jargon_density, is_grade_level_ok): difficult words are those of three syllables or more, once each."""
    # each word once; three groups of vowels take five letters
    difficult = F.filter(F.array_distinct(F.transform(T.read_words("text"), F.lower)), lambda w: (F.length(w) >= 5) & (T.syllables(w) >= 3))
    words = F.size(F.filter(F.split(squeeze("text"), " "), lambda w: w != ""))
    out = rows.select("doc_id", T.flesch_kincaid_grade("text").alias("flesch_kincaid_grade"), F.size(difficult).alias("jargon_count"), words.alias("n"))
    return out.select("doc_id", "flesch_kincaid_grade", "jargon_count", py_round(ratio(F.col("jargon_count"), F.col("n")) * 100, 2).alias("jargon_density"), F.col("flesch_kincaid_grade").between(9, 12).alias("is_grade_level_ok"))


def token_depths(heads: Column) -> Column:
    """Steps of every token to its root, of an array of head positions from 0; a root is its own head. In a circle, the sentence's length.

    By doubling: after k rounds a token knows its ancestor 2^k steps up and how many steps of these go to another
    token, so a sentence of n tokens takes log n rounds. A head that is no token gives null.
    """
    size = F.size(heads)
    start = F.struct(heads.alias("at"), F.transform(heads, lambda h, i: (h != i).cast("int")).alias("d"))

    def capped(d: Column) -> Column:
        return F.when(d <= size, d).when(d > size, size)

    def doubled(a: Column, _: Column) -> Column:
        further = F.transform(a["at"], lambda x: F.get(a["at"], x))
        return F.struct(further.alias("at"), F.zip_with(a["d"], a["at"], lambda d, x: capped(d + F.get(a["d"], x))).alias("d"))

    rounds = F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int") + 1
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(F.aggregate(F.sequence(F.lit(1), rounds), start, doubled, lambda a: a["d"]))


def dependency_depth(parsed: DataFrame) -> DataFrame:
    """(doc_id, max_dependency_depth, avg_dependency_depth) of sentences (doc_id, heads, is_punct): mean of sentence means, punctuation left out."""
    rows = parsed.select("doc_id", "is_punct", token_depths(F.col("heads")).alias("d"))
    rows = rows.select("doc_id", F.filter("d", lambda x, i: ~F.get("is_punct", i)).alias("d"))
    mean = ratio(F.aggregate("d", F.lit(0), lambda a, x: a + x), F.size("d"))
    return rows.groupBy("doc_id").agg(F.coalesce(F.max(F.array_max("d")), F.lit(0)).alias("max_dependency_depth"), py_round(F.avg(mean), 2).alias("avg_dependency_depth"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def adjacent_cosine(lines: DataFrame) -> DataFrame:
    """(doc_id, section, line_pos, score): each line's embedding with the one before it in its section."""
    w = Window.partitionBy("doc_id", "section").orderBy("line_pos")
    rows = lines.withColumn("before", F.lag("embedding").over(w)).where("before is not null")
    return rows.select("doc_id", "section", "line_pos", cosine(F.col("before"), F.col("embedding")).alias("score"))


def coherence(scores: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(doc_id, coherence, low_count, worst_section): means over all pairs; the section with the least mean, the first on a tie."""
    by = scores.groupBy("doc_id", "section").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.count_if(F.col("score") < threshold).alias("low"))
    return by.groupBy("doc_id").agg((F.sum("s") / F.sum("n")).alias("coherence"), F.sum("low").alias("low_count"), F.min_by("section", F.struct(F.col("s") / F.col("n"), "section")).alias("worst_section"))


def members(applications: DataFrame) -> DataFrame:
    """(doc_id, has_joint_lead, lead_fte, members): the team of (doc_id, raw), lead first, then joint lead."""
    team = F.from_json(F.get_json_object("raw", "$['LEAD APPLICANT & RESEARCH TEAM']"), f"`Lead Applicant` {PERSON}, `Joint Lead Applicant` {PERSON}, `Co-Applicants` array<{PERSON}>")
    rows = applications.select("doc_id", team.alias("t"))
    every = F.filter(F.concat(F.array("t.Lead Applicant", "t.Joint Lead Applicant"), F.coalesce("t.Co-Applicants", F.array().cast(f"array<{PERSON}>"))), lambda p: p.isNotNull())
    named = F.transform(every, lambda p: F.struct(*[T.text_or_empty(p[c]).alias(n) for c, n in (("Full Name", "full_name"), ("Organisation", "organisation"), ("Proposed Role", "proposed_role"), ("ORCID", "orcid"), ("% FTE Commitment", "fte"))]))
    return rows.select("doc_id", F.col("t.Joint Lead Applicant").isNotNull().alias("has_joint_lead"), T.parse_percent(F.col("t.Lead Applicant")["% FTE Commitment"]).alias("lead_fte"), F.coalesce(named, F.array().cast("array<struct<full_name:string,organisation:string,proposed_role:string,orcid:string,fte:string>>")).alias("members"))


def _count(a: Column | str, test) -> Column:
    return F.size(F.filter(a, test)).cast("long")


def team_composition(team: DataFrame) -> DataFrame:
    n, fte = F.size("members"), F.aggregate("members", F.lit(0.0), lambda a, m: a + T.parse_percent(m["fte"]))
    has_id = _count("members", lambda m: strip(m["orcid"]) != "")
    return team.select("doc_id", n.cast("long").alias("team_size"), py_round(fte, 2).alias("total_fte_commitment"), py_round(ratio(fte, n), 2).alias("avg_fte_commitment"), F.col("lead_fte").alias("lead_fte_commitment"), "has_joint_lead", has_id.alias("orcid_count"), py_round(ratio(has_id, n), 2).alias("orcid_coverage_ratio"))


def experience(team: DataFrame) -> DataFrame:
    """Publication, grant, leadership, mentorship, trajectory and clinical words in roles; citations named; lengths of roles."""
    rows = team.withColumn("roles", F.lower(T.role_text(F.col("members"))))
    cited = F.transform(F.regexp_extract_all("roles", F.lit(r"(\d{1,3}(?:,\d{3})*)\s*citations?"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long"))
    words = F.aggregate("members", F.lit(0), lambda a, m: a + F.size(F.filter(F.split(squeeze(m["proposed_role"]), " "), lambda w: w != "")))
    k = {name: T.keyword_count("roles", kw) for name, kw in (("pub", PUBLICATION), ("grant", GRANT), ("lead", LEADERSHIP), ("mentor", MENTORSHIP), ("way", TRAJECTORY), ("clinical", CLINICAL))}
    low = lambda c: F.lower(c)
    return rows.select(
        "doc_id",
        k["pub"].alias("publication_mention_count"),
        (k["pub"] > 0).alias("has_publication_mentions"),
        k["grant"].alias("grant_mention_count"),
        (k["grant"] > 0).alias("has_prior_grants"),
        F.coalesce(F.array_max(cited), F.lit(0)).alias("max_citations_mentioned"),
        words.cast("long").alias("total_role_description_words"),
        py_round(ratio(words, F.size("members")), 1).alias("avg_role_description_words"),
        k["lead"].alias("leadership_mention_count"),
        k["mentor"].alias("mentorship_mention_count"),
        _count("members", lambda m: any_of(SENIOR_TITLES, lambda t: F.contains(low(m["full_name"]), t))).alias("senior_title_count"),
        k["way"].alias("career_trajectory_signals"),
        k["clinical"].alias("clinical_mention_count"),
        _count("members", lambda m: any_of(CLINICAL_ROLES, lambda t: F.contains(low(m["proposed_role"]), t) | F.contains(low(m["full_name"]), t))).alias("clinical_team_members"),
        (k["clinical"] > 0).alias("has_clinical_academic_focus"),
    )


def org_type(org: Column) -> Column:
    o = F.lower(org)
    has = lambda *words: any_of(words, lambda w: F.contains(o, w))
    return F.when(o == "", None).when(has("nhs", "trust"), "nhs").when(has("university", "college"), "university").when(has("charity", "rnid", "cancer research"), "charity").otherwise("other")


def organisations(team: DataFrame) -> DataFrame:
    orgs = F.filter(F.transform("members", lambda m: m["organisation"]), lambda o: o != "")
    kinds = F.transform(orgs, org_type)
    of = lambda kind: _count(kinds, lambda k: k == kind)
    distinct = F.size(F.array_distinct(orgs)).cast("long")
    return team.select("doc_id", distinct.alias("unique_organisations"), of("nhs").alias("nhs_members"), of("university").alias("university_members"), of("charity").alias("charity_members"), (distinct > 1).alias("has_multi_org_collaboration"))


def applicant_features(applications: DataFrame) -> DataFrame:
    team = members(applications)
    return team_composition(team).join(experience(team), "doc_id").join(organisations(team), "doc_id")


def project_metrics(applications: DataFrame) -> DataFrame:
    info = F.from_json(F.get_json_object("raw", "$['SUMMARY INFORMATION']"), "map<string,string>")
    rows = applications.select("doc_id", info.alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    months = F.coalesce(F.when(strip(get("Duration (months)")).rlike(r"^[+-]?\d+$"), strip(get("Duration (months)")).try_cast("int")), F.lit(0))
    cost, support, excess = (T.parse_currency(get(k)) for k in ("Total Cost to NIHR", "NHS Support Costs", "NHS Excess Treatment Costs"))
    rows = rows.select("doc_id", cost.alias("total_cost_to_nihr"), months.alias("duration_months"), support.alias("nhs_support_costs"), excess.alias("nhs_excess_treatment_costs"), (F.lower(T.text_or_empty(get(RESUBMITTED))) == "yes").alias("is_resubmission"))
    return rows.withColumn("cost_per_month", F.when(F.col("duration_months") > 0, py_round(F.try_divide("total_cost_to_nihr", "duration_months"), 2)).otherwise(0.0)).withColumn("total_nhs_costs", F.col("nhs_support_costs") + F.col("nhs_excess_treatment_costs"))


def allocation(rows: DataFrame, text: str = "budget") -> DataFrame:
    """Budget categories that a text names, and the amount beside public involvement."""
    t = T.text_or_empty(text)
    has = lambda words: T.contains_any(t, words)
    return rows.select("doc_id", has(PPI).alias("has_ppi_budget"), T.category_amount(t, PPI).alias("ppi_budget_amount"), has(CAPACITY).alias("has_capacity_building"), has(EQUIPMENT).alias("has_equipment_costs"), has(STAFF).alias("has_staff_costs"))


def budget_features(applications: DataFrame) -> DataFrame:
    budget = applications.select("doc_id", F.get_json_object("raw", "$['SUMMARY BUDGET']").alias("budget"))
    return project_metrics(applications).join(allocation(budget), "doc_id")


def document_features(applications: DataFrame) -> DataFrame:
    """One wide row an application: sentences, plain English, applicants, budget."""
    secs = sections(applications)
    plain = secs.where(F.col("section").isin("Plain English Summary of Research", "Plain English Summary")).groupBy("doc_id").agg(F.min_by("text", "section_pos").alias("text"))
    return applications.select("doc_id").join(sentence_metrics(merged(secs)), "doc_id", "left").join(plain_english(plain), "doc_id", "left").join(applicant_features(applications), "doc_id", "left").join(budget_features(applications), "doc_id", "left")
