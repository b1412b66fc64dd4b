"""The pipeline's stages against plain versions, on rows with every kind of edge."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from quillspark.llm import secret_scan

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if name != "quality" else {}
        docs = stage(spark, docs, SF).cache()
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert len(rows) == docs.count()
        seen[name] = rows
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            assert all(d in rows for d, q in labels.items() if q == 1) and sum(d in rows for d, q in labels.items() if q == 0) <= 2
        elif name == "near_duplicates":
            want = brute([(d, r["text"]) for d, r in sorted(before.items())])
            assert set(rows) == {d for d, (_, c) in want.items() if c == d}
        elif name == "secrets":
            assert set(rows) == set(before)
            for d, r in rows.items():
                assert secret_scan.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
                assert secret_scan.all_spans(before[d]["text"])[1] or r["text"] == before[d]["text"]
        elif name == "mixing":
            assert 0.4 * len(before) < len(rows) <= len(before) and all(before[d] == r for d, r in rows.items())
        else:
            assert set(rows) == set(before) and all(r["n_tokens"] > 0 for r in rows.values())
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == {d: r["ids_sha256"] for d, r in seen["tokens"].items()}


def test_edges(spark, tmp_path):
    def prose(i):
        return f"A plain sentence with several common words in it, number {i} of the lot. " * 6

    rows = [(i, prose(i), "en", "s", None, "h", True, 0.5) for i in range(30)]
    rows += [(5, prose(5), "en", "s", 3, "h", True, 0.5), (None, prose(77), None, None, None, None, None, None), (101, None, "en", "s", 0, "h", False, 0.1), (102, "", None, "s", 0, "h", False, 0.1), (103, "word " * 200_000, "en", "s", 1, "h", True, 0.2), (104, prose(104) + "token = abcdefgh1234", "en", "t", 9, "h", True, 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host string, kept boolean, quality double")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path)).cache()
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "quality":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in out.collect()} == {101, 102}
        if name == "secrets":
            assert "[SECRET]" in out.where("doc_id = 104").first()["text"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_of_one_id_are_decided_the_same_way(spark):
    """Of rows of one id the same one stays however the table is split; groups that the id links are one."""
    rows = [(1, f"only this text stands alone number {w} of them", "en", "s", 9) for w in "abcdef"] + [(1, "only this text stands alone number a of them", "en", "s", 9)]
    rows += [(2, "x y z u v w a b c d e f g h", "en", "s", 1), (None, "x y z u v w a b c d e f g h", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = set()
    for n in (1, 3, 7):
        got = corpus_pipeline.without_near_duplicates(spark, docs.repartition(n), "").collect()
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "None", "None"]
        seen.add(next(r["text"] for r in got if r["doc_id"] == 1))
    assert len(seen) == 1
    assert corpus_pipeline.without_near_duplicates(spark, docs.limit(0), "").count() == 0
