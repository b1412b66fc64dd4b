import json
import random

from pyspark.sql import functions as F

from quillspark.operators import lines as L
from quillspark.plans import parsing
from quillspark.plans.scoring import checkpointed
from quillspark.sources import pages as P
from quillspark.sources.scorers import FakeScorer


def word(text, x, top, height=9.0):
    return {"text": text, "x0": x, "top": top, "x1": x + 10.0, "bottom": top + height}


def line(text, top, height=9.0):
    return [word(w, 50.0 + 12 * i, top, height) for i, w in enumerate(text.split())]


def page(lines, rects=()):
    return {"text": "\n".join(t for t, *_ in lines), "width": 600.0, "height": 842.0, "words": [w for x in lines for w in line(*x)], "rects": list(rects)}


BAND = {"top": 70.0, "bottom": 85.0, "width": 500.0, "fill": True}


def docs():
    f = [
        page([("Lead Applicant Dr Ann Lee", 100.0)]),
        page([("1. Application Summary Information", 72.0), ("Host organisation (name)", 100.0), ("Old University", 120.0), ("Proposed start date x", 140.0), ("01/02/2027", 160.0)], [BAND]),
        page([("4. Scientific Abstract", 72.0), ("An abstract", 100.0)], [BAND]),
        page([("goes on", 100.0)]),
        page([("11. Participants and Signatories", 72.0), ("Supervisor", 100.0), ("Title Dr", 120.0), ("Forename(s) Bo", 140.0), ("Surname Ek", 160.0), ("Position Reader", 180.0)], [BAND]),
    ]
    box = {"top": 190.0, "bottom": 210.0, "width": 500.0, "fill": True}
    r = [page([("RfPB stage 2", 100.0), ("Research Title A trial", 120.0), ("Start Date 03/04/2027", 140.0), ("3. Scientific abstract", 200.0), ("the body", 240.0)], [box])]
    g = [page([("SUMMARY INFORMATION", 100.0, 12.4), ("Application Title A plan", 120.0), ("LEAD APPLICANT & RESEARCH TEAM", 140.0, 12.4), ("Lead Applicant", 160.0), ("Full Name Cy", 180.0), ("APPLICATION DETAILS", 200.0, 12.4), ("Detailed Research Plan", 220.0), ("we plan", 240.0), ("END", 260.0, 12.4)])]
    return {b"f": f, b"r": r, b"g": g}


def decoder(content):
    return docs()[content]


def test_each_layout(spark):
    files = spark.createDataFrame([("f", ".pdf", bytearray(b"f")), ("r", ".pdf", bytearray(b"r")), ("g", ".pdf", bytearray(b"g")), ("bad", ".pdf", bytearray(b"z"))], "doc_id string, extension string, content binary")
    pages = P.decode(files, decoder, "doc_id").cache()
    assert pages.where("error is not null").count() == 1
    f = json.loads(parsing.fellowship(pages.where("doc_id = 'f'")).first()["raw"])
    assert f["doc_type"] == "fellowship" and f["SUMMARY INFORMATION"] == {"Contracting Organisation": "Old University", "Start Date": "01/02/2027"}
    assert f["APPLICATION DETAILS"] == {"Scientific Abstract": "An abstract\ngoes on"}
    team = f["LEAD APPLICANT & RESEARCH TEAM"]
    assert team["Lead Applicant"]["Full Name"] == "Dr Ann Lee" and team["Lead Applicant"]["Organisation"] == "Old University"
    assert [(p["Full Name"], p["Position"]) for p in team["Co-Applicants"]] == [("Dr Bo Ek", "Reader")]
    r = json.loads(parsing.rfpb(pages.where("doc_id = 'r'")).first()["raw"])
    assert r["APPLICATION DETAILS"] == {"Scientific Abstract": "the body"} and r["SUMMARY INFORMATION"]["Start Date"] == "03/04/2027"
    assert parsing.rfpb(pages.where("doc_id = 'g'")).count() == 0
    g = json.loads(parsing.generic(pages.where("doc_id = 'g'")).first()["raw"])
    assert g["APPLICATION DETAILS"] == {"Detailed Research Plan": "we plan"} and g["SUMMARY INFORMATION"] == {"Application Title": "A plan"}
    assert g["LEAD APPLICANT & RESEARCH TEAM"]["Lead Applicant"] == {"Full Name": "Cy"}


def test_route_and_fallback(spark):
    files = spark.createDataFrame([("r", ".pdf", bytearray(b"r")), ("f", ".pdf", bytearray(b"f")), ("w", ".docx", bytearray(b""))], "doc_id string, extension string, content binary")
    pages = P.decode(files.where("doc_id <> 'w'"), decoder, "doc_id").cache()
    texts = spark.createDataFrame([("w", "short"), ("x", "")], "doc_id string, text string")
    back = parsing.structure(texts, FakeScorer((("short", 'Sure: {"A": {"b": "c"}}'),)))
    got = {r["doc_id"]: r for r in parsing.parse(files, pages, texts, back).collect()}
    assert {k: v["parser"] for k, v in got.items()} == {"r": "rfpb", "f": "fellowship", "w": "fallback"}
    assert json.loads(got["w"]["raw"]) == {"doc_type": "llm_fallback", "A": {"b": "c"}}
    plain = parsing.structure(texts, FakeScorer((), "no json")).where("doc_id = 'w'").first()["raw"]
    assert json.loads(plain)["APPLICATION DETAILS"] == {"Raw Content": "short"}


def test_folder_to_table(spark, tmp_path):
    """Files are parsed once; what no layout fits is structured by a model, or tried again."""
    source, out = tmp_path / "in", str(tmp_path / "out" / "parsed")
    source.mkdir()
    (source / "f.pdf").write_bytes(b"f")
    (source / "w.docx").write_bytes(b"no docx")
    seen = []

    def store(df, name):
        df = checkpointed(df, name)
        seen.append((name, df.count()))
        return df

    def parse(generate=None):
        return {r["doc_id"]: r for r in parsing.parse_folder(spark, str(source), out, generate, decoder, store).collect()}

    first = parse()
    assert first["f"]["parser"] == "fellowship" and first["w"]["raw"] == "{}"
    (source / "r.pdf").write_bytes(b"r")
    seen.clear()
    again = parse(FakeScorer((), '{"A": {"b": "c"}}'))
    assert dict(seen)["to_parse"] == 2 and again["r"]["parser"] == "rfpb" and again["f"] == first["f"] and set(again) == {"f", "r", "w"}


def test_boxes_of_a_page_become_stretches(spark):
    rng = random.Random(5)
    boxes = [(d, 0, float(a), float(a + rng.choice([3, 3, 8]))) for d in (0, 1) for a in (rng.randrange(40 + 400 * d) for _ in range(300))] + [(0, 1, 9.0, 2.0), (0, 1, None, 5.0), (0, 1, 30.0, None)]
    rows = [(d, p, float(a), float(a + h)) for d in (0, 1, 2) for p in (0, 1) for a in range(0, 500, 3) for h in (0, 2)] + [(0, 0, None, 5.0), (0, 1, 0.0, 10.0)]
    box = spark.createDataFrame(boxes, "doc_id int, page int, top double, bottom double")
    wide = box.select("*", F.lit(True).alias("fill"), F.lit(90.0).alias("width"), F.lit(100.0).alias("page_width"))
    line = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, doc_id int, page int, top double, bottom double")
    got = {r.i: r.in_box for r in L.mark_in_box(line, wide).collect()}
    over = lambda r, b: r[:2] == b[:2] and None not in r + b and r[2] <= b[3] and r[3] >= b[2]
    assert got == {i: any(over(r, b) for b in boxes) for i, r in enumerate(rows)}
    assert L.covered(box.where("doc_id = 0 and page = 0")).count() < 12
