"""Career and citation features: works, fundings and citation counts of a person, and of a team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.columns import py_round, ratio, strings, strip

# Words in titles that tell of policy and of clinical work.
POLICY_WORDS = (
    "policy", "guideline", "nhs", "nice", "intervention", "inequal", "equity",
    "population", "public health", "oecd", "universal health care", "health service",
)
CLINICAL_WORDS = (
    "diagnosis", "neonatal", "hospital", "admission", "readmission", "trial",
    "meta-analysis", "systematic review", "dementia", "dengue", "rt-pcr",
)
# Standing of funders, in the order in which names are tried.
PRESTIGE = (
    ("national institute for health and care research", 3),
    ("uk research and innovation", 3),
    ("medical research council", 3),
    ("engineering and physical sciences research council", 3),
    ("biotechnology and biological sciences research council", 3),
    ("economic and social research council", 3),
    ("natural environment research council", 3),
    ("science and technology facilities council", 3),
    ("national institutes of health", 3),
    ("nsf", 3),
    ("european research council", 3),
    ("wellcome", 2),
    ("bill & melinda gates foundation", 2),
)
# Groups of types of work.
TYPE_GROUPS = {
    "journal_article_total": ("journal-article",),
    "presentations_total": ("lecture-speech", "conference-presentation", "presentation"),
    "reports_total": ("report", "working-paper", "other"),
    "dataset_total": ("dataset",),
    "software_total": ("software",),
    "patent_total": ("patent",),
}
ORCID = r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]"


def prestige(org: Column, table: tuple[tuple[str, int], ...] = PRESTIGE) -> Column:
    """The exact name's standing, else that of the first name contained; 0 if none."""
    key = F.lower(strip(T.text_or_empty(org)))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table])
    exact, part = (F.get(F.filter(entries, test), F.lit(0))["v"] for test in (lambda e: e["k"] == key, lambda e: F.contains(key, e["k"])))
    return F.when(key == "", 0).otherwise(F.coalesce(exact, part, F.lit(0)))


def is_recent(year: Column, now: int, window: int) -> Column:
    return F.coalesce(year >= now - (window - 1), F.lit(False))


def output_features(works: DataFrame, now: int, key: str = "orcid") -> DataFrame:
    """One row a person with works: totals, windows, types, career, recency, title hits."""
    kind = F.lower(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown")))
    rows = works.withColumn("kind", kind)
    title = F.nullif(F.col("title"), F.lit(""))
    hit = lambda words: F.coalesce(T.contains_any(title, words) & title.isNotNull(), F.lit(False))
    out = rows.groupBy(key).agg(
        F.count("*").alias("works_total"),
        F.count_if(F.coalesce(F.col("doi"), F.lit("")) != "").alias("works_with_doi"),
        F.min("year").alias("first_pub_year"),
        F.max("year").alias("last_pub_year"),
        F.count_if(is_recent(F.col("year"), now, 3)).alias("works_recent_3y"),
        F.count_if(is_recent(F.col("year"), now, 5)).alias("works_recent_5y"),
        *[F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in TYPE_GROUPS.items()],
        F.count_distinct("kind").alias("output_diversity"),
        F.sum(T.recency_weight(F.col("year"), now)).alias("pub_score_recency"),
        F.count_if(hit(POLICY_WORDS)).alias("policy_title_hits"),
        F.count_if(hit(CLINICAL_WORDS)).alias("clinical_title_hits"),
    )
    career = F.when(F.col("first_pub_year").isNull(), 1).otherwise(F.greatest(F.lit(1), now - F.col("first_pub_year") + 1))
    return (
        out.withColumn("career_years", career)
        .withColumn("works_with_doi_ratio", ratio(F.col("works_with_doi"), F.col("works_total")))
        .withColumn("works_per_year", F.col("works_total") / F.col("career_years"))
        .withColumn("societal_focus_ratio", ratio(F.col("policy_title_hits"), F.col("works_total")))
        .withColumn("first_pub_year_missing", F.col("first_pub_year").isNull().cast("int"))
    )


def type_counts(works: DataFrame, key: str = "orcid") -> DataFrame:
    """(key, type_counts): a map of types to counts."""
    kind = F.lower(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown")))
    n = works.groupBy(key, kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("type_counts"))


def funding_features(fundings: DataFrame, key: str = "orcid") -> DataFrame:
    org = F.lower(T.text_or_empty("org"))
    out = fundings.withColumn("standing", prestige(F.col("org"))).groupBy(key).agg(
        F.count("*").alias("funding_total"),
        F.sum("standing").alias("funder_score_sum"),
        F.max("standing").alias("funder_score_max"),
        F.bool_or(F.contains(org, F.lit("national institute for health and care research"))).cast("int").alias("funder_nihr_flag"),
        F.bool_or(F.contains(org, F.lit("uk research and innovation"))).cast("int").alias("funder_ukri_flag"),
        F.count("start_year").alias("with_year"),
    )
    return out.withColumn("has_funding_records", (F.col("funding_total") > 0).cast("int")).withColumn("funding_has_start_year_ratio", ratio(F.col("with_year"), F.col("funding_total"))).drop("with_year")


def h_index(counts: DataFrame, key: str, value: str = "cited_by", name: str = "h_index") -> DataFrame:
    """(key, h): the most papers that have as many citations each."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value)))
    return counts.withColumn("_rank", rank).groupBy(key).agg(F.coalesce(F.max(F.when(F.col(value) >= F.col("_rank"), F.col("_rank"))), F.lit(0)).alias(name))


def upper_median(values: Column) -> Column:
    """The middle value, the upper of two, of an array; null if empty."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def citation_features(works: DataFrame, citations: DataFrame, now: int, key: str = "orcid") -> DataFrame:
    """One row a person with works: coverage and sums of the citations found, h-indexes, upper median, best papers.

    citations: (doi, cited_by); a DOI whose count is null was asked for in vain and counts as not found.
    """
    rows = works.where(F.coalesce(F.col("doi"), F.lit("")) != "").join(citations.where("cited_by is not null").dropDuplicates(["doi"]), "doi")
    recent = is_recent(F.col("year"), now, 5)
    sums = rows.groupBy(key).agg(F.count("*").alias("matched"), F.sum("cited_by").alias("citations_total"), F.coalesce(F.sum(F.when(recent, F.col("cited_by"))), F.lit(0)).alias("citations_recent_5y"), F.max("cited_by").alias("citations_top1"))
    ranked = rows.withColumn("_up", F.row_number().over(Window.partitionBy(key).orderBy("cited_by"))).withColumn("_down", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cited_by")))).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    middle = ranked.groupBy(key).agg(F.max(F.when(F.col("_up") == F.floor(F.col("_n") / 2) + 1, F.col("cited_by"))).alias("citations_median_per_paper"), F.sum(F.when(F.col("_down") <= 3, F.col("cited_by"))).alias("citations_top3_sum"))
    base = output_features(works, now, key).select(key, "works_with_doi", "career_years")
    out = base.join(sums, key, "left").join(middle, key, "left").join(h_index(rows, key), key, "left").join(h_index(rows.where(recent), key, name="h_index_recent_5y"), key, "left")
    out = out.fillna(0, ["matched", "citations_total", "citations_recent_5y", "citations_top1", "citations_median_per_paper", "citations_top3_sum", "h_index", "h_index_recent_5y"])
    return out.withColumn("citations_available", F.lit(1)).withColumn("citation_coverage_ratio", ratio(F.col("matched"), F.col("works_with_doi"))).withColumn("citations_per_year", F.col("citations_total") / F.col("career_years")).drop("matched", "works_with_doi", "career_years")


def features(persons: DataFrame, works: DataFrame, fundings: DataFrame, citations: DataFrame | None, now: int, key: str = "orcid") -> DataFrame:
    """One wide row a person, with or without works, fundings and citations."""
    out = persons.join(output_features(works, now, key), key, "left").join(type_counts(works, key), key, "left").join(funding_features(fundings, key), key, "left")
    zeros = ["works_total", "works_with_doi", "works_recent_3y", "works_recent_5y", *TYPE_GROUPS, "output_diversity", "policy_title_hits", "clinical_title_hits", "funding_total", "has_funding_records", "funder_score_sum", "funder_score_max", "funder_nihr_flag", "funder_ukri_flag"]
    out = out.fillna(0, zeros).fillna(0.0, ["pub_score_recency", "works_with_doi_ratio", "works_per_year", "societal_focus_ratio", "funding_has_start_year_ratio"]).fillna(1, ["career_years", "first_pub_year_missing"])
    if citations is not None:
        found = citation_features(works, citations, now, key)
        ints = [c for c in found.columns if c not in (key, "citation_coverage_ratio", "citations_per_year")]
        out = out.join(found, key, "left").fillna(0, ints).fillna(0.0, ["citation_coverage_ratio", "citations_per_year"]).withColumn("citations_available", F.lit(1))
    return out.withColumn("now_year", F.lit(now))


def team_members(applications: DataFrame) -> DataFrame:
    """(doc_id, member_pos, role_group, name, organisation, proposed_role, orcid) of (doc_id, raw)."""
    person = "struct<`Full Name`:string,Organisation:string,`Proposed Role`:string,ORCID:string>"
    team = F.from_json(F.get_json_object("raw", "$['LEAD APPLICANT & RESEARCH TEAM']"), f"`Lead Applicant` {person}, `Joint Lead Applicant` {person}, `Co-Applicants` array<{person}>")
    rows = applications.select("doc_id", team.alias("t"))
    member = lambda group, p: F.struct(F.lit(group).alias("role_group"), p.alias("p"))
    co = F.transform(F.coalesce("t.Co-Applicants", F.array().cast(f"array<{person}>")), lambda p: member("Co-Applicant", p))
    both = F.concat(F.array(member("Lead Applicant", F.col("t.Lead Applicant")), member("Joint Lead Applicant", F.col("t.Joint Lead Applicant"))), co)
    rows = rows.select("doc_id", F.posexplode(F.filter(both, lambda m: m["p"].isNotNull())).alias("member_pos", "m"))
    text = lambda c: strip(T.text_or_empty(F.col("m.p")[c]))
    return rows.select("doc_id", "member_pos", "m.role_group", F.coalesce(F.nullif(text("Full Name"), F.lit("")), F.col("m.role_group")).alias("name"), text("Organisation").alias("organisation"), text("Proposed Role").alias("proposed_role"), F.regexp_extract(text("ORCID"), ORCID, 0).alias("orcid"))


def enrich_team(members: DataFrame, person_features: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members with status and figures, one row a document of team means).

    Leads and joint leads alone are looked up; person_features: orcid, works_total,
    works_recent_5y, funding_total, h_index, citations_total; failed: orcid, error.
    """
    rows = members.join(person_features, "orcid", "left")
    if failed is not None:
        rows = rows.join(failed.select("orcid", "error"), "orcid", "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    status = F.when(~F.col("role_group").isin("Lead Applicant", "Joint Lead Applicant"), "skipped").when(F.col("orcid") == "", "missing_orcid").when(F.col("works_total").isNull(), "error").otherwise("ok")
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    mean = lambda c: py_round(F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)), 2)
    team = rows.groupBy("doc_id").agg(F.count("*").alias("team_size"), F.count_if(F.col("orcid") != "").alias("orcid_count"), py_round(F.count_if(F.col("orcid") != "") / F.count("*"), 2).alias("orcid_coverage_ratio"), F.count_if(ok).alias("resolved_profiles"), mean("h_index").alias("avg_h_index"), mean("citations_total").alias("avg_citations"), mean("works_recent_5y").alias("avg_works_recent_5y"))
    return rows, team


__all__ = ["POLICY_WORDS", "CLINICAL_WORDS", "PRESTIGE", "TYPE_GROUPS", "citation_features", "enrich_team", "features", "funding_features", "h_index", "is_recent", "output_features", "prestige", "strings", "team_members", "type_counts", "upper_median"]
