"""The package reaches Python workers that don't share the driver's folder; stopped writes are not taken as tables."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from quillspark import cluster
from quillspark.plans import scoring

REPO = Path(__file__).resolve().parents[1]
PROGRAM = """
import json, sys
sys.path.insert(0, {repo!r})  # the driver's path alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from quillspark.operators import chunks, rubric
from quillspark.plans import scoring
from quillspark.sources import pages, profiles
from quillspark.sources.scorers import FakeScorer
app = {{"doc_type": "rfpb", "APPLICATION DETAILS": {{"Detailed Research Plan": "We plan a trial with clear aims."}}}}
apps = spark.createDataFrame([("d", json.dumps(app))], "doc_id string, raw string")
print("chunks", chunks.pool(apps).count())
print("scored", scoring.score(apps, rubric.load(spark), FakeScorer(())).overall.count())
files = spark.createDataFrame([("f", bytearray(b"x"))], "stem string, content binary")
print("pages", pages.decode(files).first()["error"] is not None)
print("asked", profiles.cited_by(spark.createDataFrame([("10.1/a",)], "doi string"), "http://127.0.0.1:9", profiles.Ask(retries=0)).first()["status"])
"""


def test_workers_import_the_package(tmp_path):
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "SPARK_HOME", "PYSPARK_PYTHON")}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=str(REPO))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    said = [x.strip() for x in done.stdout.splitlines() if x.strip()]
    assert said[-4:] == ["chunks 3", "scored 1", "pages True", "asked unavailable"], done.stderr[-2000:]


def test_a_stopped_write_is_written_again(spark, tmp_path):
    put = scoring.store_in(str(tmp_path))
    (tmp_path / "rows" / "_temporary").mkdir(parents=True)
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert put(df, "rows").count() == 2
    assert put(df.limit(1), "rows").count() == 2  # complete now: not written again


def test_stored_tables_go(spark):
    t = cluster.stored(spark.range(3).toDF("x"), "some")
    where = t._stored_at.removeprefix("file:")
    assert t.count() == 3 and Path(where).exists()
    cluster.forget(t)
    assert not Path(where).exists()


def test_scratch_tables_go_but_for_those_kept(spark):
    at = lambda t: Path(t._stored_at.removeprefix("file:"))
    with cluster.scratch():
        with cluster.scratch() as keep:
            a, b = cluster.stored(spark.range(1).toDF("x"), "a"), keep(cluster.stored(spark.range(2).toDF("x"), "b"))
        assert not at(a).exists() and b.count() == 2
    assert not at(b).exists()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        """A context of a cluster without a checkpoint folder; each step leads on to itself."""

        master = "spark://x"
        _jsc = property(lambda self: self)

        def sc(self):
            return self

        getCheckpointDir = sc

        def isEmpty(self):
            return True

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d: d})()

    with pytest.raises(RuntimeError):
        cluster.shared_dir(Session())


def test_baseline_shares_all_but_the_request(spark):
    from quillspark.operators import rubric
    from quillspark.sources.scorers import FakeScorer

    app = {"doc_type": "rfpb", "APPLICATION DETAILS": {"Detailed Research Plan": "We plan a trial with clear aims."}}
    apps = spark.createDataFrame([("d", json.dumps(app)), ("f", json.dumps({"note": "FAILHERE"}))], "doc_id string, raw string")
    pr = {"pr.1": {"signals": {f"pr.1.{c}": 4 for c in "abcdef"}, "used_chunk_ids": ["secdrp__001"], "pros": "clear", "drawbacks": ""}}
    flat, nested = (json.dumps(x) for x in (pr, {"proposed_research": pr}))
    scores = []
    for answer in (flat, nested):
        done = scoring.baseline(apps, rubric.load(spark), FakeScorer((("FAILHERE", "broken"), ("Score every signal", answer))))
        assert {r["doc_id"] for r in done.failures.collect()} == {"f"}
        assert done.sections.where("section_key = 'proposed_research'").first()["score_10"] == 1.0
        scores.append(done.overall.select("doc_id", "score_10").collect())
    assert scores[0] == scores[1] == [("d", 0.2)]
