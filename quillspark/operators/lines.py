"""Positioned words and lines of pages to headed sections, summary fields and teams.

Tables: words and lines (doc_id, page from 0, text, x0, top, x1, bottom, page_height),
boxes (doc_id, page, top, bottom, width, page_width, fill), page_texts (doc_id, page, text).
Reading order is (page, top, x0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.columns import squeeze, strip

# Bands of a page that are neither header nor footer, by layout.
BANDS = {"fellowship": (58.0, 805.0), "rfpb": (58.0, 805.0), "generic": (79.0, 791.0)}
HEADING_BAND = (69.0, 86.0)
BOX_WIDTH = 0.55
BIG_BOX_HEIGHT = (12.3, 12.5)
# Headings of the layouts, and the names under which their sections are kept.
FELLOWSHIP_SECTIONS = {
    "Applicant CV": "Applicant CV",
    "Applicant Research Background": "Applicant Research Background",
    "Plain English Summary of Research": "Plain English Summary of Research",
    "Scientific Abstract": "Scientific Abstract",
    "Detailed Research Plan": "Detailed Research Plan",
    "Patient & Public Involvement": "Patient & Public Involvement",
    "Training & Development and Research Support": "Training & Development and Research Support",
}
RFPB_SECTIONS = {
    "Scientific abstract": "Scientific Abstract",
    "Plain English Summary": "Plain English Summary of Research",
    "Changes from first stage": "Changes from Previous Stage",
    "Detailed Research plan": "Detailed Research Plan",
    "Research Plan": "Detailed Research Plan",
    "Patient & Public Involvement": "Patient & Public Involvement",
    "CV - Lead Applicant(s)": "Applicant CV",
}
RFPB_HEADINGS = (
    "The Research Team", "History of application", "Scientific abstract", "Plain English Summary", "Changes from first stage",
    "Detailed Research plan", "Research Plan", "Patient & Public Involvement", "Detailed Budget", "Management & Governance", "Uploads",
    "Administrative contact details", "Research & Development office contact", "Research and Development office contact details",
    "Acknowledgement review and submit", "CV - Lead Applicant(s)", "CV - Co-applicants", "Lead Applicant Details", "Research Team Details",
)
# Headings of small sections and the sections that they stand for.
SMALL_HEADINGS = {
    "Scientific Abstract": "Scientific Abstract",
    "Plain English Summary": "Plain English Summary of Research",
    "Plain English Summary of Research": "Plain English Summary of Research",
    "Changes from Previous Stage": "Changes from Previous Stage",
    "Detailed Research Plan": "Detailed Research Plan",
    "Patient & Public Involvement": "Patient & Public Involvement",
    "Working with People and Communities Summary": "Patient & Public Involvement",
}
# Keys of a summary, the question among them, roles and fields of a team.
SUMMARY_KEYS = ("Application Title", "Contracting Organisation", "Department", "Start Date", "End Date", "Duration (months)", "Total Cost to NIHR", "NHS Support Costs")
QUESTION = "Has this application been previously submitted to this or any other funding body?"
QUESTION_START = "Has this application been"
TEAM_ROLES = ("Lead Applicant", "Joint Lead Applicant", "Co-Applicants")
TEAM_FIELDS = ("Full Name", "Organisation", "Department", "Proposed Role", "ORCID", "% FTE Commitment")


def reading_order(*keys: str) -> list[Column]:
    return [F.col(k) for k in (*keys, "page", "top", "x0")]


def without_watermark(chars: DataFrame) -> DataFrame:
    """Characters (…, r, g, b) that aren't pale grey; missing colours stay."""
    grey = (F.abs(F.col("r") - F.col("g")) < 0.05) & (F.abs(F.col("g") - F.col("b")) < 0.05) & (F.col("r") > 0.7)
    return chars.where(~F.coalesce(grey, F.lit(False)))


def lines_of(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words whose tops fall in one bucket, from left to right, as a line with the box around them."""
    bucket = F.bround(F.col("top") / tolerance).cast("long")
    text = strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " "))
    out = words.groupBy("doc_id", "page", bucket.alias("bucket")).agg(text.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.first("page_height").alias("page_height"))
    return out.where("text <> ''").drop("bucket")


def in_band(lines: DataFrame, layout: str) -> DataFrame:
    low, high = BANDS[layout]
    return lines.where((F.col("bottom") >= low) & (F.col("top") <= high))


def wide_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.where(F.col("fill") & (F.col("width") >= BOX_WIDTH * F.col("page_width")))


def covered(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, top, bottom): the stretches of a page that boxes cover, apart from each other; a box whose top lies under its bottom stays as it is."""
    rows = boxes.where("top is not null and bottom is not null").select("doc_id", "page", "top", "bottom").distinct().withColumn("odd", F.col("top") > F.col("bottom"))
    w = Window.partitionBy("doc_id", "page", "odd").orderBy("top", "bottom")
    reach = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", F.col("odd") | reach.isNull() | (F.col("top") > reach))
    rows = rows.withColumn("nth", F.sum(F.col("first").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("doc_id", "page", "odd", "nth").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("odd", "nth")


def mark_in_box(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines (top at or over bottom) with in_box: whether they overlap a wide filled box of their page.

    A range join on equal pages with the stretches that boxes cover, not with each box: a page has room for few of
    these however many boxes it has.
    """
    b = covered(wide_boxes(boxes)).groupBy("doc_id", "page").agg(F.collect_list(F.struct("top", "bottom")).alias("boxes"))
    hit = F.exists("boxes", lambda x: (F.col("top") <= x["bottom"]) & (F.col("bottom") >= x["top"]))
    return lines.join(b, ["doc_id", "page"], "left").withColumn("in_box", F.coalesce(hit, F.lit(False))).drop("boxes")


def mark_section_pages(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines with is_section_page: whether the page has a filled box in the heading band."""
    pages = boxes.where(F.col("fill") & F.col("top").between(*HEADING_BAND)).select("doc_id", "page").distinct().withColumn("is_section_page", F.lit(True))
    return lines.join(pages, ["doc_id", "page"], "left").fillna(False, ["is_section_page"])


def strip_number(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^\d+\.\s+", "")


def heading_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_number(c)), "[^a-z0-9]+", "")


def normal_heading(c: Column) -> Column:
    """Without a colon at the end, white space squeezed."""
    return squeeze(F.regexp_replace(strip(c), r"\s*:\s*$", ""))


def is_fellowship_heading() -> Column:
    return F.col("is_section_page") & F.col("top").between(*HEADING_BAND)


def is_rfpb_heading() -> Column:
    key = heading_key(F.col("text"))
    known = F.array(*[heading_key(F.lit(h)) for h in RFPB_HEADINGS])
    return F.col("in_box") & F.exists(known, lambda k: F.startswith(key, k))


def is_big_box_heading() -> Column:
    t = strip("text")
    return (t != "") & (F.upper(t) == t) & (F.col("bottom") - F.col("top")).between(*BIG_BOX_HEIGHT)


HEADINGS = {"fellowship": is_fellowship_heading, "rfpb": is_rfpb_heading, "generic": is_big_box_heading}


def sectioned(lines: DataFrame, layout: str) -> DataFrame:
    """lines with is_heading, heading_no (0 before the first) and heading, carried forward."""
    w = Window.partitionBy("doc_id").orderBy("page", "top", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("is_heading", F.coalesce(HEADINGS[layout](), F.lit(False)))
    return rows.withColumn("heading_no", F.sum(F.col("is_heading").cast("int")).over(w)).withColumn("heading", F.last(F.when(F.col("is_heading"), strip("text")), ignorenulls=True).over(w))


def titles(rows: DataFrame) -> DataFrame:
    return rows.where("is_heading").select("doc_id", "heading_no", strip("text").alias("title"))


def slices(rows: DataFrame, layout: str, names: dict[str, str]) -> DataFrame:
    """Lines of the wanted sections: (…, section), each from the first heading that matches to the next one.

    A generic box that is the last of its document is left out.
    """
    heads = rows.where("is_heading").select("doc_id", "heading_no", strip("text").alias("t"))
    if layout == "generic":
        heads = heads.join(heads.groupBy("doc_id").agg(F.max("heading_no").alias("last")), "doc_id").where("heading_no < last").drop("last")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h"), F.lit(n).alias("section")) for i, (h, n) in enumerate(names.items())])
    met = heads.select("doc_id", "heading_no", "t", F.explode(wanted).alias("w"))
    test = F.startswith(heading_key(F.col("t")), heading_key(F.col("w.h"))) if layout == "rfpb" else strip_number(F.col("t")) == F.col("w.h") if layout == "fellowship" else F.col("t") == F.col("w.h")
    first = met.where(test).groupBy("doc_id", "w.section", "w.i").agg(F.min("heading_no").alias("heading_no"))
    body = rows.where(~F.col("is_heading") & (F.col("heading_no") > 0))
    filled = first.join(body.select("doc_id", "heading_no").distinct(), ["doc_id", "heading_no"], "left_semi")
    best = filled.groupBy("doc_id", "section").agg(F.min_by("heading_no", "i").alias("heading_no"), F.min("i").alias("section_pos"))
    return body.join(best, ["doc_id", "heading_no"])


def joined(rows: DataFrame, skip_first: bool = False) -> DataFrame:
    """(doc_id, section, section_pos, text): lines that hold text, joined by newlines; a generic box drops its first line."""
    if skip_first:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("page", "top", "x0"))).where("_n > 1").drop("_n").withColumn("text", strip("text"))
    part = F.struct("page", "top", "x0", "text")
    kept = rows.where(strip("text") != "")
    return kept.groupBy("doc_id", "section").agg(F.min("section_pos").alias("section_pos"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "\n").alias("text"))


def details(lines: DataFrame, layout: str) -> DataFrame:
    """(doc_id, section, section_pos, text) of a layout's sections."""
    if layout == "generic":
        return small_sections(sectioned(lines, layout).where("heading = 'APPLICATION DETAILS' and not is_heading"))
    return joined(slices(sectioned(lines, layout), layout, FELLOWSHIP_SECTIONS if layout == "fellowship" else RFPB_SECTIONS))


def small_sections(lines: DataFrame) -> DataFrame:
    """Sections by small headings, synonyms as one; a heading that comes again starts its section anew."""
    name = F.create_map(*[F.lit(x) for kv in SMALL_HEADINGS.items() for x in kv])
    w = Window.partitionBy("doc_id").orderBy("page", "top", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("head", F.try_element_at(name, normal_heading(F.col("text"))))
    rows = rows.withColumn("no", F.count("head").over(w)).withColumn("section", F.last("head", ignorenulls=True).over(w)).where("section is not null")
    last = rows.groupBy("doc_id", "section").agg(F.max("no").alias("no"))
    order = F.array_position(F.array(*[F.lit(s) for s in dict.fromkeys(SMALL_HEADINGS.values())]), F.col("section")).cast("int")
    part = F.when(F.col("head").isNull() & (strip("text") != ""), F.struct("page", "top", "x0", "text"))
    out = rows.join(last, ["doc_id", "section", "no"]).groupBy("doc_id", "section").agg(strip(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "\n")).alias("text"))
    return out.select("doc_id", "section", order.alias("section_pos"), "text")


def page_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, heading, text): texts of pages from one with a heading to the next, of (doc_id, page, heading or null, text)."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pages.withColumn("no", F.count("heading").over(w)).withColumn("name", F.last("heading", ignorenulls=True).over(w)).where("no > 0")
    runs = rows.groupBy("doc_id", "no", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return runs.groupBy("doc_id", F.col("name").alias("heading")).agg(F.min_by("text", "no").alias("text"))


def _found(raw: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(raw, pattern, group)), F.lit(""))


def fellowship_summary(raw: Column) -> dict[str, Column]:
    """Summary fields of a section's raw text; null where not found."""
    host = _found(raw, r"Host organisation[^\n]*\n([^\n]+)")
    one, two = _found(raw, r"(.+)\nResearch Title\n(.+)"), _found(raw, r"(.+)\nResearch Title\n(.+)", 2)
    return {
        "Contracting Organisation": F.when(~host.rlike(r"^([Pp]artner|applicable)"), host),
        "Application Title": F.nullif(F.concat_ws(" ", one, two), F.lit("")),
        "Duration (months)": _found(raw, r"\bDuration\b[\s\S]*?\n(\d+)\s*\n"),
        "Start Date": _found(raw, r"Proposed start date[^\n]*\n([0-9]{2}/[0-9]{2}/[0-9]{4})"),
    }


def rfpb_summary(raw: Column) -> dict[str, Column]:
    before, after = _found(raw, r"([^\n]+)\nResearch Title[^\n]*\n(.+)"), _found(raw, r"([^\n]+)\nResearch Title[^\n]*\n(.+)", 2)
    title = F.when(~before.rlike("(?i)(Programme|Call|Reference|Lead Applicant|Host|Start Date)"), F.concat(before, F.lit(" "), after)).otherwise(F.coalesce(after, _found(raw, r"Research Title[:\s]*\n?(.+)")))
    org = [F.when(~x.rlike(r"^([Pp]artner|applicable|\d)"), x) for x in (_found(raw, r"Host organisation\s+([^\n]+)"), _found(raw, r"Host organisation[^\n]*\n([^\n]+)"))]
    date = lambda k: _found(raw, rf"{k}[:\s]*\n?([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})")
    cost = [_found(raw, rf"(?i)(?:Estimated\s+)?(?:Research\s+)?Costs?[^\n]*?({p}[\d,]+\.\d{{2}})") for p in ("[£$]", "")]
    return {
        "Application Title": title,
        "Contracting Organisation": F.coalesce(*org),
        "Start Date": date("Start Date"),
        "End Date": date("End Date"),
        "Duration (months)": _found(raw, r"(?i)(?:Grant\s+)?Duration[^\n]*?(\d+)\s*(?:months?)?(?:\s|$|\n)"),
        "Total Cost to NIHR": F.coalesce(*cost),
    }


def summary_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, key, values) of a block of "key value" lines.

    A line that begins with a key opens an entry; others go on with the last one, unless its key
    takes no continuation. A key that comes again has several values.
    """
    t = strip("text")
    rows = lines.withColumn("t", t).where((t != "") & (t != "Costs") & ~t.startswith("Partner Organisation"))
    tail = F.split(F.regexp_extract("t", f"({QUESTION_START}.*)", 1), r"\s+")
    yes_no = lambda x: F.when(x.isin("Yes", "No"), x)
    asked = F.col("t").contains(QUESTION_START)
    answer = F.coalesce(yes_no(F.get(tail, F.lit(4))), F.when(F.size(tail) >= 5, yes_no(F.try_element_at(tail, F.lit(-1)))), F.lit(""))
    money = lambda prefix: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("t", r"(£\s?\d[\d,]*\.\d{2})", 1), " ", ""), F.lit("")), strip(F.substring("t", len(prefix) + 1, 10_000)))
    key = F.when(asked, QUESTION).when(F.col("t") == "Contracting Organisation Department", "Department")
    value = F.when(asked, answer).when(F.col("t") == "Contracting Organisation Department", "")
    for prefix in ("NHS Excess Treatment", "Non-NHS Excess Treatment"):
        hit = F.col("t").startswith(prefix)
        key, value = key.when(hit, f"{prefix} Costs"), value.when(hit, money(prefix))
    for k in SUMMARY_KEYS:
        hit = (F.col("t") == k) | F.col("t").startswith(f"{k} ")
        rest = strip(F.substring("t", len(k) + 1, 10_000))
        if k == "Duration (months)":
            rest = F.coalesce(F.nullif(F.regexp_extract(rest, r"^\d+", 0), F.lit("")), rest)
        elif k == "Contracting Organisation":
            rest = strip(F.regexp_replace(rest, r"(?<=.)Partner Organisation.*$", ""))
        key, value = key.when(hit, k), value.when(hit, rest)
    w = Window.partitionBy("doc_id").orderBy("page", "top", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("key", key).withColumn("value", value)
    rows = rows.withColumn("no", F.count("key").over(w)).withColumn("open", F.last("key", ignorenulls=True).over(w)).where("no > 0")
    closed = (QUESTION, "Duration (months)", "Start Date", "End Date")
    rows = rows.where(F.col("key").isNotNull() | ~F.col("open").isin(*closed))
    part = F.struct("page", "top", "x0", F.coalesce("value", "t").alias("s"))
    entry = rows.groupBy("doc_id", "open", "no").agg(strip(F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["s"]), lambda s: s != ""), " ")).alias("value"), F.max(F.col("t") == "Contracting Organisation Department").alias("label_only"))
    out = entry.groupBy("doc_id", F.col("open").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "value"))), lambda x: x["value"]).alias("values"))
    wide = out.groupBy("doc_id").agg(F.max(F.when(F.col("key") == "Contracting Organisation", F.col("values"))).alias("org"), F.max(F.when(F.col("key") == "Department", F.array_join("values", ""))).alias("dep"))
    fix = wide.where((F.size("org") == 2) & (F.coalesce("dep", F.lit("")) == ""))
    moved = fix.select("doc_id", F.explode(F.array(F.struct(F.lit("Contracting Organisation").alias("key"), F.slice("org", 1, 1).alias("values")), F.struct(F.lit("Department").alias("key"), F.slice("org", 2, 1).alias("values")))).alias("e")).select("doc_id", "e.key", "e.values")
    return out.join(moved.select("doc_id", "key"), ["doc_id", "key"], "left_anti").unionByName(moved)


PERSON = r"Title\s+(\S+)\s*\nForename\(s\)\s+(.+?)\s*\nSurname\s+(.+?)\s*\n"
# How a person's block goes on and ends, and role headers, by layout.
PEOPLE = {
    "fellowship": (r"(?s)" + PERSON + r"Position\s+(.+?)()(?=\nTitle|\nSupervisor|\nDoctoral|\nHost Organisation|\z)", r"Doctoral Primary Supervisor|Supervisor"),
    "rfpb": (r"(?s)" + PERSON + r"(?:Position\s+(.+?)\s*\n)?(?:Organisation\s+(.+?)(?=\nTitle|\nRole|\nLead|\nCo-|\z))?", r"Lead Applicant|Co-[Aa]pplicant|Co [Aa]pplicant|Collaborator|Statistician|Trial Manager|Research Nurse|Researcher"),
}


def people(raw: DataFrame, layout: str) -> DataFrame:
    """(doc_id, person_pos, full_name, proposed_role, position, organisation) of (doc_id, text): blocks under role headers."""
    pattern, roles = PEOPLE[layout]
    parts = raw.select("doc_id", F.posexplode(F.split(T.text_or_empty("text"), rf"(?m)^(?=(?:{roles})\s*\n)")).alias("seg", "s"))
    parts = parts.select("doc_id", "seg", F.regexp_extract("s", rf"^({roles})\s*\n", 1).alias("role"), F.concat("s", F.lit("\n")).alias("s")).where("role <> ''")
    groups = F.arrays_zip(*[F.regexp_extract_all("s", F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, 6)])
    rows = parts.select("doc_id", "seg", "role", F.posexplode(groups).alias("i", "p"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "i")) - 1
    g = lambda i: squeeze(F.coalesce(F.col("p")[f"g{i}"], F.lit("")))
    out = rows.select("doc_id", pos.alias("person_pos"), squeeze(F.concat_ws(" ", g(1), g(2), g(3))).alias("full_name"), F.col("role").alias("proposed_role"), g(4).alias("position"), g(5).alias("organisation"))
    return out if layout == "fellowship" else out.where(~F.lower("proposed_role").startswith("lead applicant"))


def team_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, category, person_no, fields map) of a block of labelled lines: a new person at each role label and repeated name."""
    rows = lines.withColumn("t", strip("text")).where("t <> ''")
    order = Window.partitionBy("doc_id").orderBy("page", "top", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    label = F.when(F.col("t").isin(*TEAM_ROLES), F.col("t"))
    field = F.when(F.lit(False), "")
    for f in TEAM_FIELDS:
        field = field.when((F.col("t") == f) | F.col("t").startswith(f"{f} "), f)
    rows = rows.withColumn("label", label).withColumn("field", F.when(label.isNull(), field))
    rows = rows.withColumn("cat_no", F.count("label").over(order)).withColumn("category", F.last("label", ignorenulls=True).over(order)).where("cat_no > 0 and label is null")
    within = Window.partitionBy("doc_id", "cat_no").orderBy("page", "top", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.count_if(F.col("field") == "Full Name").over(within)
    rows = rows.withColumn("person_no", F.when(F.col("category") == "Co-Applicants", F.greatest(named, F.lit(1))).otherwise(F.lit(1)))
    person = Window.partitionBy("doc_id", "cat_no", "person_no").orderBy("page", "top", "x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("field_no", F.count("field").over(person)).withColumn("open", F.last("field", ignorenulls=True).over(person)).where("field_no > 0")
    rest = strip(F.expr("substring(t, length(field) + 1)"))
    first = F.get(F.split(rest, r"\s+"), F.lit(0))
    orcid = F.coalesce(F.nullif(F.regexp_extract(rest, r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]", 0), F.lit("")), first)
    value = F.when(F.col("field") == "ORCID", orcid).when(F.col("field") == "% FTE Commitment", first).when(F.col("field").isNotNull(), rest).otherwise(F.col("t"))
    rows = rows.withColumn("value", value).where(F.col("field").isNotNull() | ~F.col("open").isin("ORCID", "% FTE Commitment"))
    part = F.struct("page", "top", "x0", "value")
    text = strip(F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["value"]), lambda s: s != ""), " "))
    filled = rows.groupBy("doc_id", "category", "cat_no", "person_no", "open", "field_no").agg(text.alias("value"))
    latest = filled.groupBy("doc_id", "category", "cat_no", "person_no", "open").agg(F.max_by("value", "field_no").alias("value"))
    persons = latest.groupBy("doc_id", "category", "cat_no", "person_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("open", "value")))).alias("fields"))
    last = F.max("cat_no").over(Window.partitionBy("doc_id", "category"))
    return persons.withColumn("_last", last).where((F.col("category") == "Co-Applicants") | (F.col("cat_no") == F.col("_last"))).drop("_last")


def lead_name(lines: DataFrame) -> DataFrame:
    """(doc_id, lead_name): what follows "Lead Applicant" on the first page's first such line."""
    t = strip("text")
    rest = strip(F.regexp_extract(t, r"(?i)^lead applicant\s*(.*)$", 1))
    rows = lines.where((F.col("page") == 0) & F.lower(t).startswith("lead applicant")).withColumn("rest", rest).where((F.col("rest") != "") & ~F.col("rest").rlike(r"^[:(]"))
    return rows.groupBy("doc_id").agg(F.min_by("rest", F.struct("top", "x0")).alias("lead_name"))


def orcid_of(cv: Column) -> Column:
    return F.regexp_extract(T.text_or_empty(cv), r"ORCID\s+iD\s+(\S+)", 1)


def assemble(doc_type: str, summary: DataFrame, team: DataFrame, detail: DataFrame, budget: DataFrame | None = None) -> DataFrame:
    """(doc_id, raw): JSON of an application from its parts; a map of sections keeps their order.

    summary: (doc_id, fields map); team: (doc_id, team JSON); detail: (doc_id, section, section_pos, text).
    """
    parts = detail.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("section_pos", "section", "text"))), lambda x: F.struct(x["section"], x["text"]))).alias("d"))
    rows = parts.join(summary, "doc_id", "full").join(team, "doc_id", "left")
    if budget is not None:
        rows = rows.join(budget, "doc_id", "left")
    piece = lambda name, j: F.when(j.isNotNull(), F.concat(F.lit(f'"{name}":'), j))
    quoted = F.regexp_extract(F.to_json(F.struct(F.lit(doc_type).alias("x"))), r'^\{"x":(.*)\}$', 1)
    body = [piece("doc_type", quoted), piece("SUMMARY INFORMATION", F.to_json("fields")), piece("LEAD APPLICANT & RESEARCH TEAM", F.col("team")), piece("APPLICATION DETAILS", F.to_json("d"))]
    if budget is not None:
        body.append(piece("SUMMARY BUDGET", F.when(F.col("budget").isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col("budget").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))))
    return rows.select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")).alias("raw"))


def is_rfpb(first_page: Column, lines: int = 2) -> Column:
    return F.array_join(F.slice(F.split(T.text_or_empty(first_page), r"\r\n|\n|\r"), 1, lines), "\n").contains("RfPB")


def is_empty(raw: Column) -> Column:
    """Whether JSON holds nothing beside doc_type: empty texts, lists, objects, nulls, zeros and false."""
    values = F.map_values(F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, v: k != "doc_type"))
    blank = lambda v: v.isNull() | v.isin("", "[]", "{}", "null", "0", "0.0", "false")
    return F.coalesce(F.forall(values, blank), F.lit(True))


def text_length(leaf: DataFrame) -> DataFrame:
    """(doc_id, n_chars): characters of all leaves."""
    return leaf.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"))


def route(rows: DataFrame, min_chars: int = 2000) -> DataFrame:
    """rows (doc_id, extension, first_page, and candidate JSON rfpb, fellowship, generic, docx, docx_chars, fallback) with raw and parser.

    PDF: a form that names RfPB goes to that parser; others try fellowship, generic, RfPB. Documents need
    min_chars. The first candidate that isn't empty is taken, the fallback last.
    """
    use = lambda c, test=None: F.when(~is_empty(F.col(c)) & (F.lit(True) if test is None else test), F.struct(F.col(c).alias("raw"), F.lit(c).alias("parser")))
    last = F.struct(F.col("fallback").alias("raw"), F.lit("fallback").alias("parser"))
    pdf = F.when(is_rfpb(F.col("first_page")), F.coalesce(use("rfpb"), last)).otherwise(F.coalesce(use("fellowship"), use("generic"), use("rfpb"), last))
    word = F.coalesce(use("docx", F.coalesce(F.col("docx_chars"), F.lit(0)) >= min_chars), last)
    ext = F.lower("extension")
    pick = F.when(ext == ".pdf", pdf).when(ext.isin(".docx", ".doc"), word).otherwise(last)
    return rows.withColumn("_p", pick).select(*rows.columns, F.col("_p.raw").alias("raw"), F.col("_p.parser").alias("parser"))


def page_budget(pages: DataFrame, most: int = 60) -> DataFrame:
    """(doc_id, text, avg_chars): text of the first pages; characters a page over all pages, as far as text was read."""
    total = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    some = pages.where(F.col("page") < most).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"), F.sum(F.length("text")).alias("chars"))
    return some.join(total, "doc_id").select("doc_id", "text", (F.col("chars") / F.col("n")).alias("avg_chars"))


def structuring_request(text: Column, most: int = 120_000) -> Column:
    """What a structuring model gets: the text cut to most characters, and its token budget by length."""
    t = F.substring(T.text_or_empty(text), 1, most)
    return F.struct(t.alias("text"), F.greatest(F.lit(8192), F.least(F.floor(F.length(t) / 8), F.lit(32_768))).cast("int").alias("max_tokens"))
