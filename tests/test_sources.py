import io
import json
import zipfile

from pyspark.sql import functions as F

from quillspark.sources import files, pages, profiles
from quillspark.sources.scorers import FakeScorer, HttpScorer, call, recorded


def test_folder_and_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(data.getvalue())
    (tmp_path / "a.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("x")
    found = files.folder(spark, str(tmp_path))
    listed = files.listing(found)
    assert [r["name"] for r in listed.collect()] == ["a.docx", "b.docx"]
    assert "content" not in listed.columns and "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["name"]: r for r in files.docx_text(found).collect()}
    assert got["b.docx"]["text"] == "Hello there\na\tb" and got["a.docx"]["error"]


def test_json_with_conflicts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n<<<<<<< HEAD\n"x": 1\n=======\n"x": 2\n>>>>>>> other\n}\n')
    (tmp_path / "b.json").write_text('{"s": "{\\"k\\": 1}"}')
    (tmp_path / "c.json").write_text("{")
    got = {r["stem"]: r["raw"] for r in files.repaired(files.json_files(spark, str(tmp_path))).collect()}
    assert json.loads(got["a"]) == {"x": 1} and got["c"] is None
    m = spark.createDataFrame([(got["b"],)], "raw string").select(files.unwrapped(F.col("raw")).alias("m")).first()["m"]
    assert json.loads(m["s"]) == {"k": 1}


def test_csv_log_resumes(spark, tmp_path):
    path = str(tmp_path / "log")
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, v double")
    b = spark.createDataFrame([("y", 5.0), ("z", 3.0)], "name string, v double")
    assert (files.append_new(a, path, "name"), files.append_new(b, path, "name"), files.append_new(b, path, "name")) == (2, 1, 0)
    assert {(r["name"], r["v"]) for r in files.csv_rows(spark, path, "name string, v double").collect()} == {("x", 1.0), ("y", 2.0), ("z", 3.0)}
    (tmp_path / "gaps.csv").write_text("a,b\n\n1,2\n\n3,4\n")
    assert files.csv_rows(spark, str(tmp_path / "gaps.csv")).count() == 2


def test_latest_and_scores(spark, tmp_path):
    for n in ("runs_1.json", "runs_2.json"):
        (tmp_path / n).write_text(json.dumps({"sub_scores": {"g.1": 7, "g.2": -1}}))
    assert files.latest(spark, str(tmp_path / "runs_*.json")).endswith("runs_2.json")
    assert files.latest(spark, str(tmp_path / "none_*.json")) is None
    got = files.reference_scores(spark, str(tmp_path), "_2").collect()
    assert {(r["doc_id"], r["sub_id"], r["score"]) for r in got} == {("runs_1", "g.1", 7.0), ("runs_1", "g.2", -1.0), ("runs", "g.1", 7.0), ("runs", "g.2", -1.0)}


def test_profiles(spark):
    works = {"group": [{"work-summary": [{"put-code": 7, "title": {"title": {"value": "T"}}, "publication-date": {"year": {"value": "2020"}}, "type": "book", "external-ids": {"external-id": [{"external-id-type": "doi", "external-id-value": " 10.1/X "}]}}, {"put-code": 8}]}, {"work-summary": []}, {"work-summary": [{"title": None, "publication-date": None}]}]}
    df = spark.createDataFrame([("o", json.dumps(works)), ("e", "{}")], "orcid string, raw string")
    got = profiles.works(df).orderBy("work_pos").collect()
    assert [(r["title"], r["year"], r["doi"]) for r in got] == [("T", 2020, "10.1/X"), (None, None, None)]
    person = {"name": {"given-names": {"value": "A"}, "family-name": None}, "emails": {"email": [{"email": "a@b.c"}, {"email": None}]}}
    p = profiles.persons(spark.createDataFrame([("o", json.dumps(person))], "orcid string, raw string")).first()
    assert (p["full_name"], p["emails_public"]) == ("A", ["a@b.c"])
    fund = {"group": [{"funding-summary": [{"organization": {"name": "W", "address": {"city": "L", "country": "GB"}}, "start-date": {"year": {"value": "x"}}}]}]}
    f = profiles.fundings(spark.createDataFrame([("o", json.dumps(fund))], "orcid string, raw string")).first()
    assert (f["org"], f["org_city"], f["start_year"]) == ("W", "L", None)


def test_citation_lookup_retries(spark):
    def get(url):
        return (200, '{"cited_by_count": 5}') if url.endswith("10.1/a") else (404, "") if url.endswith("10.1/b") else (503, "")

    df = spark.createDataFrame([("https://doi.org/10.1/A",), ("10.1/a",), ("10.1/b",), ("10.1/c",), ("",)], "doi string")
    assert sorted(tuple(r) for r in profiles.cited_by(df, "http://x", profiles.Ask(get, parallel=2, retries=1, backoff=0.0)).collect()) == [("10.1/a", 5, "ok"), ("10.1/b", None, "missing"), ("10.1/c", None, "unavailable")]


def test_profiles_are_fetched(spark):
    def get(url):
        return (404, "") if "/gone/" in url else (200, json.dumps({"group": []})) if url.endswith("works") else (500, "")

    ids = spark.createDataFrame([("a ",), ("a",), ("gone",), ("",), (None,)], "orcid string")
    got = profiles.fetch(ids, "http://x", profiles.Ask(get, retries=1, backoff=0.0), ("works", "person")).cache()
    assert {(r["orcid"], r["record"], r["status"]) for r in got.collect()} == {("a", "works", "ok"), ("a", "person", "unavailable"), ("gone", "works", "missing"), ("gone", "person", "missing")}
    assert [r["orcid"] for r in profiles.record(got, "works").collect()] == ["a"]


def test_ocr_answers_fill_pages_without_text(spark):
    page = "doc_id string, page int, text string, png string"
    p = spark.createDataFrame([("d", 0, "", "x"), ("d", 1, "has text", "x"), ("d", 2, " ", "x"), ("e", 0, None, "x")], page)
    asked = {(r["doc_id"], r["page"]) for r in pages.ocr_requests(p.fillna("", ["text"])).collect()}
    assert asked == {("d", 0), ("d", 2), ("e", 0)}
    answers = spark.createDataFrame([("d", 0, "<think>hm</think>\n```text\nread\n```", True), ("d", 1, "other", True), ("d", 2, "bad", False)], "doc_id string, page int, raw string, ok boolean")
    got = {(r["doc_id"], r["page"]): r["text"] for r in pages.with_ocr(p, answers).collect()}
    assert got == {("d", 0): "read", ("d", 1): "has text", ("d", 2): " ", ("e", 0): None}


def test_scorers(spark):
    r = spark.createDataFrame([("a", "hello"), ("b", "other")], "doc_id string, messages string")
    got = {x["doc_id"]: x["raw"] for x in call(r, FakeScorer((("hello", '{"x":1}'),)), ("doc_id",)).collect()}
    assert got == {"a": '{"x":1}', "b": "{}"}
    told = spark.createDataFrame([("a", '{"y":2}')], "doc_id string, raw string")
    assert {x["doc_id"]: x["ok"] for x in recorded(r, told, ("doc_id",)).collect()} == {"a": True, "b": False}
    body = HttpScorer("http://x", "m").body('[{"role":"user","content":"c"}]', "{}", 5)
    assert body["stream"] is False and body["options"]["num_predict"] == 5


def test_sheets_are_written_read_and_appended(spark, tmp_path):
    path = str(tmp_path / "r.xlsx")
    a = spark.createDataFrame([("b_after", 2.5, None), ("b_before", 1.0, "x < y & z")], "name string, score double, note string")
    assert files.append_sheet(a, path, "name") == 2
    b = spark.createDataFrame([("b_after", 9.0, "other"), ("a_before", 3.0, "new"), ("a_before", 3.0, "new")], "name string, score double, note string")
    assert (files.append_sheet(b, path, "name"), files.append_sheet(b, path, "name")) == (1, 0)
    got = [tuple(r) for r in files.read_sheet(spark, path).collect()]
    assert got == [("b_after", "2.5", None), ("b_before", "1.0", "x < y & z"), ("a_before", "3.0", "new")]
    (tmp_path / "no.xlsx").write_bytes(b"none")
    assert files.sheet_rows(spark, str(tmp_path / "no.xlsx")).count() == 0
    assert files._column("AB12") == 27 and files._letters(27) == "AB"
    shared = tmp_path / "s.xlsx"
    with zipfile.ZipFile(shared, "w") as z:
        m = files.SHEET["m"]
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>k</t></si><si><r><t>v</t></r><r><t>w</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    t = files.read_sheet(spark, str(shared))
    assert t.columns == ["k", "column1", "vw"] and [tuple(r) for r in t.collect()] == [("7", None, None)]


def test_calls_overlap_in_order_and_keep_the_rate():
    import threading
    import time

    now, most, starts, lock = [0], [0], [], threading.Lock()

    def get(url):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            starts.append(time.monotonic())
        time.sleep(0.05 + 0.03 * (int(url) % 3))  # later ones may be done sooner
        with lock:
            now[0] -= 1
        return 200, url

    urls = [str(i) for i in range(64)]
    began = time.monotonic()
    assert [b for _, b in profiles.Ask(get, in_flight=8).answers(iter(urls), None)] == urls
    assert time.monotonic() - began < 64 * 0.05 / 3 and 4 <= most[0] <= 8
    starts.clear()
    began = time.monotonic()
    list(profiles.Ask(get, in_flight=8, rate=80).answers(iter(urls[:40]), 2))  # this task's part is 40 a second
    assert time.monotonic() - began >= 39 / 40
    assert all(starts[i + 10] - starts[i] >= 0.2 for i in range(0, 30))  # ten calls take a quarter of a second
    one = profiles.Ask(get, in_flight=1)
    most[0] = 0
    assert [b for _, b in one.answers(iter(urls[:5]), None)] == urls[:5] and most[0] == 1


def test_look_up_overlaps_in_tasks(spark):
    import time

    def slow(url):
        time.sleep(0.05)
        return 200, json.dumps({"cited_by_count": len(url)})

    df = spark.createDataFrame([(f"10.1/{i:03d}",) for i in range(160)], "doi string")
    took = {}
    for n in (1, 16):
        began = time.monotonic()
        got = profiles.cited_by(df, "http://x", profiles.Ask(slow, in_flight=n, parallel=1)).collect()
        took[n] = time.monotonic() - began
        assert len(got) == 160 and {r["status"] for r in got} == {"ok"}
    assert took[1] > 8 and took[16] < took[1] / 3
    assert profiles.Ask(rate=5).tasks(spark) == spark.sparkContext.defaultParallelism
