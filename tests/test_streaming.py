"""The service, its tables by job, uploads over HTTP, and the streamed fold."""

import io
import json
import random
import threading
import time
import urllib.error
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import belief, rubric
from quillspark.streaming import folding, http, keyed, service

FINDINGS = "doc_id string, section_pos int, section_name string, finding_pos int, sub_id string, good array<string>, bad array<string>, implication string"
SUBS = ["g.0", "g.1", "g.2", "g.3"]


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' for p in paragraphs)}</w:body></w:document>")
    return data.getvalue()


def answers(spark, n_docs=4, seed=1):
    """Sections and findings of some documents; a section may have no findings."""
    rng = random.Random(seed)
    sections = [(f"d{d}", i, f"S{i % 4}") for d in range(n_docs) for i in range(rng.randint(3, 9))]
    rows = [(d, i, s, k, rng.choice(SUBS[:3]), [f"c{rng.randrange(6)}", f"c{i}"], [f"b{rng.randrange(3)}"] if k else [], rng.choice([f" {s}: {rng.randrange(3)} ", "", f"{s}: x"])) for d, i, s in sections for k in range(rng.randint(0, 3))]
    return spark.createDataFrame(sections, "doc_id string, section_pos int, section_name string"), spark.createDataFrame(rows, FINDINGS)


def batch_states(spark, sections, findings):
    """doc_id -> what the stream is to end with, keys in order (rows would lose it)."""
    table = rubric.small(spark, [(s, 0, i, "x") for i, s in enumerate(SUBS)], "sub_id string, section_pos int, sub_pos int, section_key string")
    rows = belief.state(sections, findings, table).select("doc_id", F.to_json(F.struct("processed_sections", "subcriteria_beliefs", "missing_signals")).alias("j")).collect()
    begin = {"processed_sections": None, "subcriteria_beliefs": {}}
    return {r.doc_id: json.dumps(begin | json.loads(r.j)) for r in rows}


def run_fold(spark, tmp_path, batches, name, **how):
    src = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, folding.EVENT).coalesce(1).write.mode("append").parquet(str(src / f"b{i:03d}"))
    stream = spark.readStream.schema(folding.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = folding.fold_beliefs(stream, SUBS, **how).writeStream.outputMode("update").format("memory").queryName(name)
    q.trigger(availableNow=True).start().awaitTermination(300)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_fold_in_any_order_equals_batch(spark, tmp_path):
    sections, findings = answers(spark)
    want = batch_states(spark, sections, findings)
    events = [tuple(r) for r in folding.section_events(sections, findings).collect()]
    for seed in (3, 4):
        shuffled = events + random.Random(seed).sample(events, 5)  # some come twice
        random.Random(seed).shuffle(shuffled)
        rows = run_fold(spark, tmp_path, [shuffled[i : i + 8] for i in range(0, len(shuffled), 8)], f"shuffled{seed}")
        last = {}
        for r in rows:
            assert r.next_pos >= last.get(r.doc_id, r).next_pos and not r.closed
            last[r.doc_id] = r
        for d, r in last.items():
            assert r.state == want[d]
        assert last.keys() == want.keys()
        assert {r.waiting for r in last.values()} == {0}


def test_late_sections_wait_for_their_turn(spark, tmp_path):
    of = lambda i, sub: ("d", i, f"S{i}", [(0, sub, [f"c{i}"], [], "")])
    rows = run_fold(spark, tmp_path, [[of(2, "g.0"), of(3, "g.0")], [of(0, "g.0"), of(1, "g.0")]], "late")
    assert [(r.next_pos, r.waiting) for r in rows] == [(0, 2), (4, 0)]
    assert json.loads(rows[0].state)["subcriteria_beliefs"] == {}
    assert json.loads(rows[1].state)["subcriteria_beliefs"]["g.0"]["good_evidence_ids"] == ["c0", "c1", "c2", "c3"]


def test_a_gap_is_closed_and_still_filled(spark, tmp_path):
    """After the patience the waiting sections are shown; the missing one is folded in its place when it comes."""
    of = lambda i: ("d", i, f"S{i}", [(0, "g.1", [f"c{i}"], [], "")])
    src = tmp_path / "gap"
    put = lambda i, rows: spark.createDataFrame(rows, folding.EVENT).coalesce(1).write.parquet(str(src / f"b{i}"))
    put(0, [of(0), of(2)])
    stream = spark.readStream.schema(folding.EVENT).option("recursiveFileLookup", "true").parquet(str(src))
    q = folding.fold_beliefs(stream, SUBS, patience_ms=500).writeStream.outputMode("update").format("memory").queryName("gap").trigger(processingTime="200 milliseconds").start()

    def until(test):
        end = time.time() + 90
        while time.time() < end:
            rows = spark.sql("SELECT * FROM gap").collect()
            if rows and test(rows[-1]):
                return [json.loads(r.state)["subcriteria_beliefs"].get("g.1", {}).get("good_evidence_ids") for r in rows], rows[-1]
            time.sleep(0.2)
        raise AssertionError(rows)

    try:
        shown, last = until(lambda r: r.closed)
        assert shown == [["c0"], ["c0", "c2"]] and (last.next_pos, last.waiting) == (1, 1)
        put(1, [of(1)])
        shown, last = until(lambda r: r.next_pos == 3)
        assert shown[-1] == ["c0", "c1", "c2"] and (last.closed, last.waiting) == (False, 0)
    finally:
        q.stop()


def test_service(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.json").write_text('{"x": 1}')
    (inbox / "b.json").write_text("nonsense")
    (inbox / "c.txt").write_text("no document")
    (inbox / "d.docx").write_bytes(b"broken")
    work = lambda df: df.select("job_id", F.to_json(F.struct("path")).alias("result"))

    def broken(df):
        raise RuntimeError("no features")

    service.serve(service.inbox(spark, str(inbox)), out, work, str(tmp_path / "cp"), broken).awaitTermination(300)
    jobs = {r["job_id"]: r for r in service.jobs(spark, out).collect()}
    assert sorted(r["status"] for r in jobs.values()) == ["done", "failed", "failed", "failed"]
    assert {r["detail"].split(":")[0] for r in jobs.values() if r["status"] == "failed"} == {"not JSON", "no format of a document", "no layout fits, or too little text could be read"}
    done = next(j for j, r in jobs.items() if r["status"] == "done")
    assert len(done) == 12 and service.result(spark, out, done)[0] == 200 and service.result(spark, out, "nope")[0] == 404
    (inbox / "e.json").write_text('{"x": 3}')
    service.serve(service.inbox(spark, str(inbox)), out, work, str(tmp_path / "cp")).awaitTermination(300)
    assert service.jobs(spark, out).count() == 5


def test_one_bad_job_fails_alone(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for i in range(10):
        (inbox / f"{i:012x}.json").write_text(json.dumps({"poison": i == 6}))
    tries = []

    def work(df):
        tries.append(1)
        test = F.when(F.get_json_object("raw", "$.poison") == "true", F.raise_error(F.lit("poisoned"))).otherwise(F.lit("{}"))
        return df.select("job_id", test.cast("string").alias("result"), F.when(F.col("job_id") == f"{3:012x}", F.lit("said so")).alias("error"))

    service.serve(service.inbox(spark, str(inbox)), out, work, str(tmp_path / "cp")).awaitTermination(300)
    jobs = {int(r["job_id"], 16): r for r in service.jobs(spark, out).collect()}
    assert {i for i, r in jobs.items() if r["status"] == "done"} == set(range(10)) - {3, 6}
    assert "poisoned" in jobs[6]["detail"] and jobs[3]["detail"] == "said so"
    assert len(tries) <= 9


def test_a_look_up_reads_one_bucket(spark, tmp_path):
    t = keyed.Keyed(spark, str(tmp_path / "t"), "job_id string, n int, at int")
    assert t.rows().count() == 0 and t.of("j1").first() is None
    rows = lambda at, ids: spark.createDataFrame([(f"j{i}", i + at, at) for i in ids], t.schema)
    t.put(rows(0, range(300)), 0)
    t.put(rows(1, range(5)), 1)
    t.put(rows(1, range(3)), 1)  # the batch is tried again
    assert [t.of(j).first()["n"] for j in ("j1", "j4", "j299")] == [2, 4, 299]
    assert len(t.folders_of("j200")) == 1 and len(t.of("j200").inputFiles()) <= 4
    t.compact()
    t.put(rows(2, [7]), 2)
    assert {r.job_id: r.n for r in t.rows().collect()} == {f"j{i}": i + (i < 3) + 2 * (i == 7) for i in range(300)}
    assert all("/merged/" in f for f in t.folders_of("j200")) and t.of("j7").first()["n"] == 9
    t.compact()
    t.compact()  # nothing new
    assert t.rows().count() == 300 and {p.name for p in (tmp_path / "t" / "log").iterdir()} == {f"batch={2:012d}"}


def test_history(spark, tmp_path):
    (tmp_path / "0123456789ab.json").write_text('{"title": "T", "overall": {"final_score_0to100": 50}, "features": {"a": 1}}')
    (tmp_path / "0123456789ac.json").write_text("{")
    (tmp_path / "other.json").write_text("{}")
    got = service.history(spark, str(tmp_path)).collect()
    assert [(r["job_id"], r["overall"], r["n_sections"]) for r in got] == [("0123456789ab", 50.0, 1)]


def test_history_by_pages(spark, tmp_path):
    import os

    for i in range(7):
        p = tmp_path / f"{i:012x}.json"
        p.write_text(json.dumps({"title": f"T{i}"}))
        os.utime(p, (1_700_000_000 + i // 3, 1_700_000_000 + i // 3))  # some at the same time
    seen, after = [], None
    for _ in range(9):
        rows, after = service.history_page(spark, str(tmp_path), 3, after)
        seen.append([int(r["job_id"], 16) for r in rows])
        if not after:
            break
    assert seen == [[6, 5, 4], [3, 2, 1], [0]]
    (tmp_path / "none").mkdir()
    assert service.history_page(spark, str(tmp_path / "none")) == ([], None)


def form(name, content):
    edge = "----edge"
    body = f'--{edge}\r\nContent-Disposition: form-data; name="pdf"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + content + f"\r\n--{edge}--\r\n".encode()
    return body, {"Content-Type": f"multipart/form-data; boundary={edge}"}


def test_uploads_over_http(spark, tmp_path):
    inbox, out, past = (str(tmp_path / x) for x in ("inbox", "out", "past"))
    web = http.server(spark, inbox, out, past)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{web.server_port}"

    def get(path, data=None, headers=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, data, headers or {})) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert get("/progress/0123456789ab")[0] == 404 and get("/nothing")[0] == 404 and get("/upload", b"")[0] == 400
        as_json = {"Content-Type": "application/json"}
        status, said = get("/upload", b'{"title": "T"}', as_json)
        job, bad = said["job_id"], get("/upload", b"{", as_json)[1]["job_id"]
        assert status == 202 and len(job) == 12
        paper = get("/upload", *form("my plan.docx", docx("We plan a trial.", "With clear aims. " * 150)))[1]["job_id"]
        named = get("/upload", docx("Another."), {"X-Filename": "b.DOCX"})[1]["job_id"]
        assert get("/upload", *form("x.exe", b"MZ"))[0] == 415 and get("/upload", b"--x--", {"Content-Type": "multipart/form-data; boundary=x"})[0] == 400
        work = lambda df: df.select("job_id", F.to_json(F.struct(F.length("raw").alias("overall"), F.col("raw").alias("text"))).alias("result"))
        short = lambda texts: texts.select("doc_id", F.to_json(F.struct("text")).alias("raw"))
        service.serve(service.inbox(spark, inbox), out, work, str(tmp_path / "ck"), fallback=short).awaitTermination(300)
        assert {j: get(f"/progress/{j}")[1]["detail"] for j in (job, paper, named)} == {j: "" for j in (job, paper, named)}
        assert get(f"/progress/{job}")[1]["progress"] == 100 and get(f"/result/{job}")[1]["text"] == '{"title": "T"}'
        assert "We plan a trial.\\nWith clear aims. With" in get(f"/result/{paper}")[1]["text"] and "Another." in get(f"/result/{named}")[1]["text"]
        assert get(f"/progress/{bad}")[1]["status"] == "failed" and get(f"/result/{bad}")[0] == 409
        assert get("/history") == (200, {"rows": [], "next": None}) and get("/status")[0] == 200 and get("/history?size=0")[0] == 400
        (tmp_path / "past").mkdir()
        for i in range(3):
            (tmp_path / "past" / f"0123456789a{i}.json").write_text('{"title": "T", "overall": {"final_score_0to100": 50}, "features": {"a": 1}}')
        first = get("/history?size=2")[1]
        assert len(first["rows"]) == 2 and first["rows"][0]["overall"] == 50.0
        assert len(get(f"/history?size=2&after={first['next']}")[1]["rows"]) == 1
        assert get("/history/0123456789a0")[1]["title"] == "T" and get("/history/0123456789ac")[0] == 404
    finally:
        web.shutdown()


@pytest.mark.parametrize(("headers", "body", "want"), [({"Content-Type": "application/pdf"}, b"%PDF", ("upload.pdf", b"%PDF")), ({"X-Filename": "a.doc"}, b"x", ("a.doc", b"x")), ({}, b"{}", ("upload.json", b"{}"))])
def test_names_of_uploads(headers, body, want):
    from email.message import Message

    m = Message()
    for k, v in headers.items():
        m[k] = v
    if not headers:
        m["Content-Type"] = "application/json"
    assert http.upload(m, body) == want
