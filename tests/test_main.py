"""Every command, and the packed tables that they write."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.sources import packs
from quillspark.sources.scorers import FakeScorer

APP = {"doc_type": "rfpb", "APPLICATION DETAILS": {"Detailed Research Plan": "We plan a trial with clear aims."}}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(APP))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"doc_type": "x", "note": "FAILHERE"}))
    return tmp_path


def test_chunks_and_show(spark, folder, capfd):
    assert main(["chunks", str(folder / "in"), str(folder / "out")]) == 0
    assert spark.read.parquet(str(folder / "out" / "index")).count() > 0
    assert {r.doc_id for r in packs.table(spark, str(folder / "out" / "chunks")).collect()} == {"a", "b"}
    assert main(["show", str(folder / "out" / "chunks"), "a"]) == 0
    rows = [json.loads(x) for x in capfd.readouterr().out.splitlines() if x.startswith("{")]
    assert rows and {r["doc_id"] for r in rows} == {"a"} and [r["chunk_pos"] for r in rows] == sorted(r["chunk_pos"] for r in rows)


def test_score_tells_what_failed(spark, folder, capfd):
    stage1 = json.dumps({"findings": []})
    model = FakeScorer((("FAILHERE", "broken"), ("Detailed Research Plan", stage1)))
    asked = ["--url", "http://127.0.0.1:9", "--model", "m"]
    assert main(["score", str(folder / "in"), str(folder / "out"), *asked], model) == 1
    assert "stage1: " in capfd.readouterr().err
    assert {r.doc_id for r in spark.read.parquet(str(folder / "out" / "failures")).collect()} == {"b"}
    assert spark.read.parquet(str(folder / "out" / "results")).count() == 1


def test_parse_and_profile(spark, folder):
    (folder / "papers").mkdir()
    (folder / "papers" / "p.docx").write_bytes(b"broken")
    assert main(["parse", str(folder / "papers"), str(folder / "parsed")]) == 0
    assert [r.raw for r in packs.read(spark, str(folder / "parsed" / "json"), "p").collect()] == ["{}"]
    for name in ("works", "fundings"):
        (folder / name).mkdir()
        (folder / name / "0000.json").write_text(json.dumps({"group": []}))
    work = {"group": [{"work-summary": [{"title": {"title": {"value": "T"}}, "publication-date": {"year": {"value": "2020"}}, "type": "journal-article"}]}]}
    (folder / "works" / "0001.json").write_text(json.dumps(work))
    assert main(["profile", str(folder / "works"), str(folder / "fundings"), str(folder / "profiles"), "--year", "2026"]) == 0
    assert spark.read.parquet(str(folder / "profiles")).count() >= 1


def test_many_documents_in_few_files(spark, tmp_path):
    n = 20_000
    docs = spark.range(n).select(F.format_string("doc%07d", F.col("id")).alias("doc_id"), F.col("id").alias("n"))
    hot = spark.range(5000).select(F.lit("doc0000500x").alias("doc_id"), F.col("id").alias("n"))
    packs.write(docs.unionByName(hot), str(tmp_path), order=("n",), rows=2500)
    parts = list((tmp_path / "files").glob("*.parquet"))
    assert 8 <= len(parts) <= 10
    for i in (0, 777, n - 1):
        assert len(packs.files_of(spark, str(tmp_path), f"doc{i:07d}")) == 1
        rows = packs.read(spark, str(tmp_path), f"doc{i:07d}")
        assert [r.n for r in rows.collect()] == [i] and len(rows.inputFiles()) == 1
    assert packs.read(spark, str(tmp_path), "doc0000500x").count() == 5000
    assert 2 <= len(packs.files_of(spark, str(tmp_path), "doc0000500x")) <= 4
    assert packs.read(spark, str(tmp_path), "nobody").count() == 0 and packs.files_of(spark, str(tmp_path), "zzz") == []
    packs.write(docs.limit(0), str(tmp_path / "none"))
    assert packs.read(spark, str(tmp_path / "none"), "d").count() == 0
