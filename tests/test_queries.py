"""Every query with SQL equals DuckDB's result on the same tables; the others run."""

import os
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import figure_queries, flagship, registry, run_queries, score_queries, text_queries  # noqa: F401
from quillspark.plans.flagship import evidence_scores

QUERIES = registry.QUERIES | {"evidence_scores": evidence_scores}
SQL = registry.SQL | {"evidence_scores": flagship.SQL}

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in SQL
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)


def test_partition_count_does_not_matter(spark):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.append(sorted(map(repr, registry.QUERIES["belief_merge"](spark, SF).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_flagship(spark):
    got = evidence_scores(spark, SF).collect()
    assert len(got) == 20 and all(0 <= r["score_10"] <= 10 for r in got)
