import json
import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.operators import citations, evaluate, features, lines


def paths_outside(n_a, n_b, h):
    """The share of lattice paths that reach a gap of h, every path counted."""
    lcm, ways = math.lcm(n_a, n_b), {}
    for i in range(n_a + 1):
        for j in range(n_b + 1):
            inside = abs(i * lcm // n_a - j * lcm // n_b) < h
            ways[i, j] = (1 if i == j == 0 else ways.get((i - 1, j), 0) + ways.get((i, j - 1), 0)) if inside else 0
    return float(1 - Fraction(ways[n_a, n_b], math.comb(n_a + n_b, n_a)))


def counted(d, n):
    """Two samples of n by reflection, in whole numbers."""
    h = round(d * n)
    return float(Fraction(2 * sum((-1) ** (k - 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1)), math.comb(2 * n, n)))


def test_h_index_and_upper_median(spark):
    rows = [("a", c) for c in (3, 3, 3)] + [("b", c) for c in (10, 0)] + [("c", 0)]
    df = spark.createDataFrame(rows, "orcid string, cited_by long")
    assert {r["orcid"]: r["h_index"] for r in citations.h_index(df, "orcid").collect()} == {"a": 3, "b": 1, "c": 0}
    m = spark.createDataFrame([([4, 1, 3, 2],), ([],)], "x array<int>").select(citations.upper_median(F.col("x")).alias("m")).collect()
    assert [r["m"] for r in m] == [3, None]


def test_person_features(spark):
    works = spark.createDataFrame([("p", 1, "Health policy trial", 2024, "Journal-Article", "10.1/a"), ("p", 2, "Bridges", None, None, "10.1/b"), ("p", 3, None, 2010, "report", None)], "orcid string, put_code int, title string, year int, type string, doi string")
    fund = spark.createDataFrame([("p", "Wellcome Trust", 2020), ("p", None, None), ("p", " NSF ", None)], "orcid string, org string, start_year int")
    cited = spark.createDataFrame([("10.1/a", 7), ("10.1/a", 7)], "doi string, cited_by long")
    people = spark.createDataFrame([("p",), ("q",)], "orcid string")
    got = {r["orcid"]: r for r in citations.features(people, works, fund, cited, 2026).collect()}
    p, q = got["p"], got["q"]
    assert (p["works_total"], p["works_with_doi"], p["first_pub_year"], p["career_years"], p["works_recent_3y"], p["output_diversity"]) == (3, 2, 2010, 17, 1, 3)
    assert (p["policy_title_hits"], p["clinical_title_hits"], p["funder_score_sum"], p["funder_score_max"]) == (1, 1, 5, 3)
    assert (p["citations_total"], p["citation_coverage_ratio"], p["h_index"], p["citations_median_per_paper"]) == (7, 0.5, 1, 7)
    assert p["pub_score_recency"] == pytest.approx(0.7 + 0.2)
    assert (q["works_total"], q["career_years"], q["funding_total"], q["citations_total"], q["first_pub_year_missing"]) == (0, 1, 0, 0, 1)


def test_team(spark):
    raw = json.dumps({"LEAD APPLICANT & RESEARCH TEAM": {"Lead Applicant": {"Full Name": "Prof A", "ORCID": "https://orcid.org/0000-0001-2345-678X", "% FTE Commitment": "20%", "Organisation": "City NHS Trust", "Proposed Role": "Leads; 1,200 citations"}, "Joint Lead Applicant": None, "Co-Applicants": [{"Full Name": "", "% FTE Commitment": "x", "Organisation": "Old University", "Proposed Role": ""}]}})
    df = spark.createDataFrame([("d", raw)], "doc_id string, raw string")
    f = features.applicant_features(df).first()
    assert (f["team_size"], f["total_fte_commitment"], f["avg_fte_commitment"], f["lead_fte_commitment"], f["has_joint_lead"], f["orcid_count"]) == (2, 20.0, 10.0, 20.0, False, 1)
    assert (f["max_citations_mentioned"], f["publication_mention_count"], f["senior_title_count"], f["unique_organisations"], f["nhs_members"], f["university_members"]) == (1200, 1, 1, 2, 1, 1)
    m = citations.team_members(df)
    assert [(r["role_group"], r["name"], r["orcid"]) for r in m.orderBy("member_pos").collect()] == [("Lead Applicant", "Prof A", "0000-0001-2345-678X"), ("Co-Applicant", "Co-Applicant", "")]
    known = spark.createDataFrame([("0000-0001-2345-678X", 5, 2, 1, 3, 40)], "orcid string, works_total long, works_recent_5y long, funding_total long, h_index long, citations_total long")
    rows, team = citations.enrich_team(m, known)
    assert {r["status"] for r in rows.collect()} == {"ok", "skipped"}
    assert team.first()["avg_h_index"] == 3.0 and team.first()["orcid_coverage_ratio"] == 0.5


def test_budget(spark):
    raw = json.dumps({"SUMMARY INFORMATION": {"Total Cost to NIHR": "£1.2m", "Duration (months)": "24", features.RESUBMITTED: "YES"}, "SUMMARY BUDGET": "PPIE: £3k. Laptop. Salaries."})
    b = features.budget_features(spark.createDataFrame([("d", raw)], "doc_id string, raw string")).first()
    assert (b["total_cost_to_nihr"], b["duration_months"], b["cost_per_month"], b["is_resubmission"]) == (1_200_000.0, 24, 50_000.0, True)
    assert (b["has_ppi_budget"], b["ppi_budget_amount"], b["has_equipment_costs"], b["has_staff_costs"], b["has_capacity_building"]) == (True, 3000.0, True, True, False)


def test_depth_of_a_tree(spark):
    rows = [("d", [1, 1, 1, 2], [False, False, True, False])]
    got = features.dependency_depth(spark.createDataFrame(rows, "doc_id string, heads array<int>, is_punct array<boolean>")).first()
    assert (got["max_dependency_depth"], got["avg_dependency_depth"]) == (2, 1.0)


def test_document_features_without_sections(spark):
    got = features.document_features(spark.createDataFrame([("d", "{}")], "doc_id string, raw string")).first()
    assert got["total_sentences"] is None and got["team_size"] == 0 and got["has_ppi_budget"] is False


def test_p_values():
    assert evaluate.t_p_value(-3.382, 4.97) == pytest.approx(0.0199, abs=2e-4)
    assert evaluate.t_p_value(None, 3) is None and evaluate.t_p_value(0.0, 5) == pytest.approx(1.0)
    assert evaluate.ks_p_value(0.8, 5, 5) == pytest.approx(0.0794, abs=1e-4)
    # exact figures by counting paths with fractions; the last two from the distribution of one sample of n_a n_b / (n_a + n_b)
    for d, n_a, n_b, p in ((0.8, 5, 5, 0.07936507936507936), (0.4, 5, 5, 0.873015873015873), (0.1, 200, 200, 0.27047438328), (5 / 12, 12, 18, None), (18 / 35, 5, 7, 0.3282828282828283)):
        if p is not None:
            assert evaluate.ks_p_value(d, n_a, n_b) == pytest.approx(p, rel=1e-9)
    assert evaluate.ks_p_value(0.05, 1000, 1000) == pytest.approx(counted(0.05, 1000), rel=1e-9)
    assert evaluate.ks_p_value(0.0136, 20_000, 20_000) == pytest.approx(0.04903580797, rel=1e-6)
    assert evaluate.ks_p_value(0.0105, 20_000, 20_000) == pytest.approx(0.21867463664, rel=1e-6)
    assert evaluate.ks_p_value(0.05, 20_000, 20_000) < 1e-20 and evaluate.ks_p_value(1e-9, 20_000, 30_000) == 1.0
    for n_a, n_b in ((5, 7), (12, 18), (30, 31)):
        lcm = math.lcm(n_a, n_b)
        for h in range(1, lcm + 1, max(1, lcm // 9)):
            assert evaluate.ks_p_value(h / lcm, n_a, n_b) == pytest.approx(paths_outside(n_a, n_b, h), rel=1e-6, abs=1e-12)


def test_tests_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    got = {r["test"]: r for r in evaluate.tests(df, "g", "v", "a", "b").collect()}
    assert got["welch_ttest"]["statistic"] is None and got["ks_2samp"]["statistic"] == 1.0


def test_pairs_must_be_complete(spark):
    df = spark.createDataFrame([("x", "before", 1.0), ("x", "after", 3.0), ("y", "before", 1.0)], "k string, phase string, v double")
    with pytest.raises(ValueError):
        evaluate.paired_diff(df, "k", "phase", ["v"])
    got = evaluate.paired_diff(df.where("k = 'x'"), "k", "phase", ["v"])
    assert got.first()["v"] == 2.0 and evaluate.feature_stats(got, ["v"]).first()["std"] is None


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (100.0,), (101.0,)], "x double")
    assert {r["bin"]: r["n"] for r in evaluate.histogram(df, "x").collect()} == {1: 2, 2: 1, 10: 1}


def line_rows(spark, texts, top=100.0, height=10.0):
    rows = [("d", 0, t, 0.0, (top + i) if not isinstance(t, tuple) else t[1], 100.0, 0.0, 842.0) for i, t in enumerate(texts)]
    rows = [(d, p, t[0] if isinstance(t, tuple) else t, x, y, x1, y + (t[2] if isinstance(t, tuple) else height), h) for d, p, t, x, y, x1, _, h in rows]
    return spark.createDataFrame(rows, "doc_id string, page int, text string, x0 double, top double, x1 double, bottom double, page_height double")


def test_summary_block(spark):
    df = line_rows(spark, ["Application Title A long", "title", "Costs", "Contracting Organisation Old University", "Contracting Organisation Department", "Medicine", "Start Date 01/02/2026", "ignored", "NHS Excess Treatment £ 0.00 Has nothing", "x £9.00 Has this application been No previously", "Duration (months) 24 months"])
    got = {r["key"]: r["values"] for r in lines.summary_fields(df).collect()}
    assert got["Application Title"] == ["A long title"] and got["Department"] == ["Medicine"] and got["Start Date"] == ["01/02/2026"]
    assert got["NHS Excess Treatment Costs"] == ["£0.00"] and got[lines.QUESTION] == ["No"] and got["Duration (months)"] == ["24"]
    two = {r["key"]: r["values"] for r in lines.summary_fields(line_rows(spark, ["Contracting Organisation X", "Contracting Organisation Y"])).collect()}
    assert two == {"Contracting Organisation": ["X"], "Department": ["Y"]}


def test_team_block(spark):
    df = line_rows(spark, ["junk", "Lead Applicant", "Full Name Dr A", "Organisation U", "Proposed Role leads", "the study", "ORCID 0000-0001-2345-6789 x", "ignored", "Co-Applicants", "Full Name B", "% FTE Commitment 5% of", "Full Name C"])
    got = [(r["category"], r["fields"]) for r in lines.team_fields(df).orderBy("cat_no", "person_no").collect()]
    assert got == [("Lead Applicant", {"Full Name": "Dr A", "Organisation": "U", "Proposed Role": "leads the study", "ORCID": "0000-0001-2345-6789"}), ("Co-Applicants", {"Full Name": "B", "% FTE Commitment": "5%"}), ("Co-Applicants", {"Full Name": "C"})]


def test_people_by_pattern(spark):
    text = "intro\nSupervisor\nTitle Dr\nForename(s) Ann\nSurname Lee\nPosition Senior\nLecturer\nTitle Mr\nForename(s) Bo\nSurname Ek\nPosition Nurse\nHost Organisation X"
    got = lines.people(spark.createDataFrame([("d", text)], "doc_id string, text string"), "fellowship").orderBy("person_pos").collect()
    assert [(r["full_name"], r["proposed_role"], r["position"]) for r in got] == [("Dr Ann Lee", "Supervisor", "Senior Lecturer"), ("Mr Bo Ek", "Supervisor", "Nurse")]


def test_fellowship_sections(spark):
    df = line_rows(spark, [("1. Scientific Abstract", 70.0, 5.0), ("body one", 100.0, 5.0), ("   ", 101.0, 5.0), ("body two", 102.0, 5.0)]).withColumn("is_section_page", F.lit(True))
    got = lines.details(df, "fellowship").collect()
    assert [(r["section"], r["text"]) for r in got] == [("Scientific Abstract", "body one\nbody two")]


def test_generic_boxes_and_small_headings(spark):
    df = line_rows(spark, [("APPLICATION DETAILS", 10.0, 12.4), ("Plain English Summary:", 20.0, 9.0), ("old", 21.0, 9.0), ("Scientific Abstract", 22.0, 9.0), ("abs", 23.0, 9.0), ("Plain English Summary of Research", 24.0, 9.0), ("new", 25.0, 9.0), ("BUDGET", 30.0, 12.4), ("Sub", 31.0, 9.0), ("£5", 32.0, 9.0)])
    got = {r["section"]: r["text"] for r in lines.details(df, "generic").collect()}
    assert got == {"Plain English Summary of Research": "new", "Scientific Abstract": "abs"}
    assert lines.slices(lines.sectioned(df, "generic"), "generic", {"BUDGET": "SUMMARY BUDGET"}).count() == 0  # the last box has no end


def test_rfpb_headings_match_by_prefix(spark):
    df = line_rows(spark, ["3. Scientific abstract (max 300 words)", "body", "Uploads", "rest"]).withColumn("in_box", F.col("text").rlike("abstract|Uploads"))
    assert [(r["section"], r["text"]) for r in lines.details(df, "rfpb").collect()] == [("Scientific Abstract", "body")]


def test_routing(spark):
    full, none = json.dumps({"doc_type": "x", "A": {"b": "c"}}), json.dumps({"doc_type": "x", "A": {}, "B": ""})
    rows = [("1", ".pdf", "Form\nRfPB stage", full, full, full, None, None, "{}"), ("2", ".pdf", "Form", full, none, full, None, None, "{}"), ("3", ".docx", "", None, None, None, full, 10, '{"z":"y"}'), ("4", ".docx", "", None, None, None, full, 5000, "{}"), ("5", ".txt", "", None, None, None, None, None, '{"z":"y"}')]
    df = spark.createDataFrame(rows, "doc_id string, extension string, first_page string, rfpb string, fellowship string, generic string, docx string, docx_chars long, fallback string")
    assert [r["parser"] for r in lines.route(df).orderBy("doc_id").collect()] == ["rfpb", "generic", "fallback", "docx", "fallback"]


def test_ks_goes_by_ranges(spark):
    """The running sum has no window over all values, and equals one over all."""
    rows = [("a" if i % 3 else "b", float((i * 7919) % 1000) + (i % 3 == 0) * 30) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = evaluate.ks(df, "g", "v", "a", "b")
    r = got.first()
    a, b = (sorted(v for g, v in rows if g == x) for x in "ab")
    want = max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in {v for _, v in rows})
    assert (r["n_a"], r["n_b"]) == (len(a), len(b)) and r["statistic"] == pytest.approx(want, abs=1e-12)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "v#" in x and "specifiedwindowframe" in x]
    assert windows and all("part#" in x for x in windows)


def test_depths_by_doubling(spark):
    rng = random.Random(6)
    heads = [[0], [0, 0, 1], [1, 2, 3, 3], [1, 0], [1, 2, 0, 0], [], [rng.randrange(50) for _ in range(50)], *[[max(0, i - rng.randint(0, 3)) for i in range(n)] for n in (2, 3, 17, 64, 65)]]

    def depth(h, i):
        d = 0
        while h[i] != i and d < len(h):
            i, d = h[i], d + 1
        return d

    df = spark.createDataFrame(list(enumerate(heads)), "i int, heads array<int>")
    got = {r.i: r.d for r in df.select("i", features.token_depths(F.col("heads")).alias("d")).collect()}
    assert got == {n: [depth(h, i) for i in range(len(h))] for n, h in enumerate(heads)}
    chain = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.greatest(i - 1, F.lit(0))).alias("heads"))
    assert chain.select(features.token_depths(F.col("heads")).alias("d")).first().d == list(range(20_000))


def test_medians_by_ranges(spark):
    rng = random.Random(7)
    data = [(9, None)]
    for g, n in enumerate((1, 2, 5, 100, 1001, 900)):
        pick = [lambda: rng.choice([1.0, 2.0, 2.0, 2.0, 3.0]), lambda: rng.lognormvariate(0, 3), lambda: rng.choice([0.5, -7.25, 1e9, rng.random()])]
        data += [(None if g == 5 else g, pick[g % 3]()) for _ in range(n)]
    df = spark.createDataFrame(data, "g int, v double").repartition(4)
    groups = {g for g, v in data if v is not None}
    want = {g: statistics.median([v for h, v in data if h == g and v is not None]) for g in groups}
    for held in (1, 40):
        assert {r.g: r.median for r in evaluate.medians(df, held).collect()} == want
    few, many = (evaluate.group_summary(df, "g", ["v"], held).orderBy("g").collect() for held in (10_000, 10))
    assert [r.v_median for r in few] == [r.v_median for r in many] and [r.v_count for r in few] == [r.v_count for r in many]
    few, many = (evaluate.column_summary(df, ["g", "v"], held).orderBy("metric").collect() for held in (10_000, 10))
    assert [(r.metric, r.median, r["max"]) for r in few] == [(r.metric, r.median, r["max"]) for r in many]


def test_medians_send_bounds_to_rows(spark, monkeypatch):
    plans, write = [], evaluate.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(evaluate, "stored", seen)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")
    try:
        rows = spark.createDataFrame([(i % 2, float(i % 997)) for i in range(20_000)], "g int, v double")
        got = {r.g: r.v_median for r in evaluate.group_summary(rows, "g", ["v"], held=50).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {g: statistics.median([float(i % 997) for i in range(g, 20_000, 2)]) for g in (0, 1)}
    assert len(plans) > 2 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)


SENTENCES = [
    ("One two. Three four! Five? Six", ["One two.", "Three four!", "Five?", "Six"]),
    ("Dr. Smith met Prof. Jones, e.g. on Fig. 3. They spoke.", ["Dr. Smith met Prof. Jones, e.g. on Fig. 3.", "They spoke."]),
    ("It cost 3.5 million. In 2020. Then 5%. Done.", ["It cost 3.5 million.", "In 2020.", "Then 5%.", "Done."]),
    ("J. R. Brown of the U.S. Army came.", ["J. R. Brown of the U.S. Army came."]),
    ("The NHS. It works.", ["The NHS.", "It works."]),
    ('He left. "Go now." She went (at last). Why?', ['He left. "', 'Go now."', "She went (at last).", "Why?"]),
    ("Wait... what? Yes.", ["Wait... what?", "Yes."]),
    ("end.Next one", ["end.", "Next one"]),
    ("see www.host.org now. Next", ["see www.host.org now.", "Next"]),
    ("Apples, pears, etc. are here. Apples etc. Then more.", ["Apples, pears, etc. are here.", "Apples etc.", "Then more."]),
    ("Really?! Yes!!! No", ["Really?!", "Yes!!!", "No"]),
    ("Smith et al. 2020 showed it. Number no. 5 is no. It is.", ["Smith et al. 2020 showed it.", "Number no. 5 is no.", "It is."]),
    ("A list: a. first b. second. End", ["A list: a. first b. second.", "End"]),
    ("Line one.\n\nLine two.\tTabbed", ["Line one.", "Line two.", "Tabbed"]),
    ("日本語。次の文。 終", ["日本語。次の文。", "終"]),
    ("Étude finie. Élan", ["Étude finie.", "Élan"]),
    ("At 5 p.m. we met. It was 5 p.m. We left.", ["At 5 p.m. we met.", "It was 5 p.m.", "We left."]),
    ("Hm - yes. - No. -5 degrees", ["Hm - yes. -", "No.", "-5 degrees"]),
    ("", []),
    (None, []),
    (" . ", ["."]),
    ("no end", ["no end"]),
]


def test_sentences_by_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", features.sentences("t").alias("s")).collect()}
    assert [(SENTENCES[i][0], got[i]) for i in sorted(got)] == SENTENCES
