"""Decoded pages to application JSON: each layout's parser, the router, and structuring by a model as the last resort.

A later parser runs only on documents that the earlier ones left empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..cluster import is_complete
from ..functions import text as T
from ..operators import lines as L
from ..sources import files, pages as P
from ..sources.scorers import Generate, call
from .scoring import Store, checkpointed

RAW_CONTENT = "Raw Content"


def _map(fields: dict[str, Column]) -> Column:
    """A map of the fields that were found, in their order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))


def _lead(name: Column, organisation: Column, orcid: Column) -> Column:
    e = F.lit("")
    person = F.struct(name.alias("Full Name"), T.text_or_empty(organisation).alias("Organisation"), e.alias("Department"), F.lit("Lead Applicant").alias("Proposed Role"), T.text_or_empty(orcid).alias("ORCID"), e.alias("% FTE Commitment"))
    return F.when(T.text_or_empty(name) != "", person)


def _team(lead: DataFrame, raw: DataFrame, layout: str) -> DataFrame:
    """(doc_id, team): lead (doc_id, lead_name, organisation, orcid) and people of raw (doc_id, text) as JSON."""
    e = F.lit("").alias
    one = F.struct("person_pos", F.struct(F.col("full_name").alias("Full Name"), F.col("proposed_role").alias("Proposed Role"), F.col("organisation").alias("Organisation"), e("Department"), e("ORCID"), F.col("position").alias("Position")).alias("p"))
    co = L.people(raw, layout).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["p"]).alias("co"))
    rows = lead.join(co, "doc_id", "left")
    none = F.lit(None).cast("string")
    team = F.struct(_lead(F.col("lead_name"), F.col("organisation"), F.col("orcid")).alias("Lead Applicant"), none.alias("Joint Lead Applicant"), F.col("co").alias("Co-Applicants"))
    return rows.select("doc_id", F.to_json(team).alias("team"))


def _headed(pages: DataFrame, line: DataFrame, layout: str) -> DataFrame:
    """(doc_id, heading, text): raw texts of pages, from a page with a heading to the next such page."""
    heads = L.sectioned(line, layout).where("is_heading").groupBy("doc_id", "page").agg(F.min_by(L.strip_number(F.col("text")), F.struct("top", "x0")).alias("heading"))
    return L.page_sections(pages.select("doc_id", "page", "text").join(heads, ["doc_id", "page"], "left"))


def _named(sections: DataFrame, name: str, prefix: bool = False) -> DataFrame:
    test = F.startswith(L.heading_key(F.col("heading")), L.heading_key(F.lit(name))) if prefix else F.col("heading") == name
    return sections.where(test).groupBy("doc_id").agg(F.min("text").alias("text"))


def fellowship(pages: DataFrame, store: Store = checkpointed) -> DataFrame:
    """(doc_id, raw); a document of any kind gets one, at least with its type."""
    line = store(L.in_band(L.mark_section_pages(L.lines_of(P.words(pages)), P.boxes(pages)), "fellowship"), "fellowship_lines")
    headed = store(_headed(pages, line, "fellowship"), "fellowship_sections")
    docs = pages.select("doc_id").distinct()
    info = docs.join(_named(headed, "Application Summary Information"), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = L.fellowship_summary(F.col("text"))
    summary = info.select("doc_id", _map(fields).alias("fields"))
    cv = _named(headed, "Applicant CV").select("doc_id", L.orcid_of(F.col("text")).alias("orcid"))
    lead = info.select("doc_id", fields["Contracting Organisation"].alias("organisation")).join(L.lead_name(line), "doc_id", "left").join(cv, "doc_id", "left")
    return L.assemble("fellowship", summary, _team(lead, _named(headed, "Participants and Signatories"), "fellowship"), L.details(line, "fellowship"))


def rfpb(pages: DataFrame, store: Store = checkpointed) -> DataFrame:
    """(doc_id, raw) of documents with a heading of this layout."""
    line = store(L.in_band(L.mark_in_box(L.lines_of(P.words(pages)), P.boxes(pages)), "rfpb"), "rfpb_lines")
    known = store(L.sectioned(line, "rfpb").where("is_heading").select("doc_id").distinct(), "rfpb_known")
    headed = store(_headed(pages, line, "rfpb"), "rfpb_sections")
    first = known.join(pages.where("page = 0").select("doc_id", "text"), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    summary = first.select("doc_id", _map(L.rfpb_summary(F.col("text"))).alias("fields"))
    team_text = _named(headed, "The Research Team", True)
    org = team_text.select("doc_id", F.regexp_extract("text", r"Organisation\s+([^\n]+)", 1).alias("organisation"))
    cv = _named(headed, "CV - Lead Applicant(s)", True).select("doc_id", L.orcid_of(F.col("text")).alias("orcid"))
    lead = known.join(L.lead_name(line), "doc_id", "left").join(org, "doc_id", "left").join(cv, "doc_id", "left")
    return L.assemble("rfpb", summary, _team(lead, team_text, "rfpb"), L.details(line, "rfpb").join(known, "doc_id", "left_semi"))


def generic(pages: DataFrame, store: Store = checkpointed) -> DataFrame:
    """(doc_id, raw) of documents with boxed titles in capitals."""
    line = store(L.in_band(L.lines_of(P.words(pages)), "generic"), "generic_lines")
    rows = store(L.sectioned(line, "generic"), "generic_sections")
    block = lambda title: L.slices(rows, "generic", {title: title})
    values = L.summary_fields(block("SUMMARY INFORMATION"))
    one = F.when(F.size("values") == 1, F.get("values", F.lit(0))).otherwise(F.to_json("values"))
    summary = values.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", one)))).alias("fields"))
    people = L.team_fields(block("LEAD APPLICANT & RESEARCH TEAM"))
    who = lambda c: F.max(F.when(F.col("category") == c, F.to_json("fields")))
    co = F.transform(F.sort_array(F.collect_list(F.when(F.col("category") == "Co-Applicants", F.struct("cat_no", "person_no", F.to_json("fields").alias("j"))))), lambda x: x["j"])
    team = people.groupBy("doc_id").agg(who("Lead Applicant").alias("lead"), who("Joint Lead Applicant").alias("joint"), co.alias("co"))
    null = F.lit("null")
    team = team.select("doc_id", F.concat(F.lit('{"Lead Applicant":'), F.coalesce("lead", null), F.lit(',"Joint Lead Applicant":'), F.coalesce("joint", null), F.lit(',"Co-Applicants":['), F.array_join("co", ","), F.lit("]}")).alias("team"))
    budget = L.joined(block("SUMMARY BUDGET"), skip_first=True).select("doc_id", F.col("text").alias("budget"))
    return L.assemble("nihr", summary, team, L.details(line, "generic"), budget)


def parse(files: DataFrame, pages: DataFrame, docx: DataFrame | None = None, fallback: DataFrame | None = None, store: Store = checkpointed) -> DataFrame:
    """(doc_id, raw, parser) of files (doc_id, extension). pages: decoded; docx: (doc_id, text); fallback: (doc_id, raw)."""
    none = F.lit(None).cast("string")
    first = pages.where("page = 0").select("doc_id", F.col("text").alias("first_page"))
    base = files.select("doc_id", "extension").join(first, "doc_id", "left")
    is_form = L.is_rfpb(F.col("first_page"))
    only = lambda docs: pages.join(docs.select("doc_id"), "doc_id", "left_semi")

    def left(docs: DataFrame, done: DataFrame) -> DataFrame:
        return docs.join(done.where(~L.is_empty(F.col("raw"))).select("doc_id"), "doc_id", "left_anti")

    pdf = base.where("lower(extension) = '.pdf'")
    other = pdf.where(~is_form)
    a = store(fellowship(only(other), store), "parsed_fellowship")
    b = store(generic(store(only(left(other, a)), "pages_generic"), store), "parsed_generic")
    c = store(rfpb(store(only(pdf.where(is_form).unionByName(left(left(other, a), b))), "pages_rfpb"), store), "parsed_rfpb")
    rows = base
    for name, done in (("fellowship", a), ("generic", b), ("rfpb", c)):
        rows = rows.join(done.withColumnRenamed("raw", name), "doc_id", "left")
    if docx is not None:
        body = F.to_json(F.struct(F.struct(F.col("text").alias(RAW_CONTENT)).alias("APPLICATION DETAILS")))
        rows = rows.join(docx.select("doc_id", F.when(T.text_or_empty("text") != "", body).alias("docx"), F.length("text").cast("long").alias("docx_chars")), "doc_id", "left")
    else:
        rows = rows.withColumn("docx", none).withColumn("docx_chars", F.lit(None).cast("long"))
    rows = rows.join(fallback.withColumnRenamed("raw", "fallback"), "doc_id", "left") if fallback is not None else rows.withColumn("fallback", none)
    return L.route(rows).select("doc_id", F.coalesce("raw", F.lit("{}")).alias("raw"), "parser")


def structure(texts: DataFrame, generate: Generate, schema: str = "{}") -> DataFrame:
    """(doc_id, raw) by a model, of (doc_id, text); an answer that isn't an object gives the text as it is."""
    request = L.structuring_request(F.col("text"))
    messages = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Structure this application as JSON:\n"), request["text"]).alias("content"))))
    asked = texts.where(T.text_or_empty("text") != "").select("doc_id", messages.alias("messages"), F.lit(schema).alias("schema"), request["max_tokens"].alias("tokens"))
    answered = call(asked, generate, ("doc_id",))
    rows = texts.join(answered.where("ok"), "doc_id", "left")
    whole = F.to_json(F.struct(F.lit("llm_fallback").alias("doc_type"), F.struct(F.col("text").alias(RAW_CONTENT)).alias("APPLICATION DETAILS")))
    found = T.json_object("raw")
    typed = F.when(F.get_json_object(found, "$.doc_type").isNull(), F.concat(F.lit('{"doc_type":"llm_fallback",'), F.substring(found, F.lit(2), F.length(found)))).otherwise(found)
    return rows.select("doc_id", F.coalesce(typed, F.when(T.text_or_empty("text") != "", whole), F.lit("{}")).alias("raw"))


def parse_folder(spark: SparkSession, source: str, out: str, generate: Generate | None = None, decoder: P.Decoder = P.pdfplumber_decoder, store: Store = checkpointed, min_chars: int = 1) -> DataFrame:
    """(doc_id, raw, parser) of a folder's files, added to the table at out; files that the table holds with text are not parsed again.

    The table is both the result and the cache: a second call after a stop, or after new files, does what is left.
    generate structures what no layout fits; without it such a file is an empty object and is tried again next time.
    """
    every = files.folder(spark, source).withColumnRenamed("stem", "doc_id")
    if is_complete(spark, out):
        every = files.cached(every, spark.read.parquet(out).where("raw <> '{}'"), "doc_id", min_chars)
    every = store(every, "to_parse")
    pages = store(P.decode(every.where("extension = '.pdf'"), decoder, "doc_id"), "pages")
    docx = store(files.docx_text(every.where("extension <> '.pdf'").withColumn("name", F.col("doc_id"))).select(F.col("name").alias("doc_id"), "text"), "docx_texts")
    fallback = None
    if generate:
        texts = L.page_budget(pages).select("doc_id", "text").unionByName(docx)
        fallback = store(structure(texts, generate), "structured")
    done = store(parse(every.select("doc_id", "extension"), pages, docx, fallback, store), "parsed")
    done.write.mode("append").parquet(out)
    latest = Window.partitionBy("doc_id").orderBy((F.col("raw") == "{}").cast("int"), F.col("_metadata.file_modification_time").desc(), "raw")
    return spark.read.parquet(out).withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth")
