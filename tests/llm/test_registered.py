"""All queries are registered, and give what their contracts name."""

from pathlib import Path

import __spark_entry__
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")],
    "op2_": [("doc_id", "bigint")],
    "op3_": [("pair_id", "bigint")],
    "op4_": [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
    "op5_": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op6_": [("doc_id", "bigint")],
    "op7_": [("doc_id", "bigint")],
    "op8_": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op9_": [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")],
    "op10_": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op11_": [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")],
    "op12_": [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")],
    "op13_": [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")],
    "pipeline": [("doc_id", "bigint"), ("n_tokens", "bigint")],
}


def test_sql(spark):
    """What SQL can say of the registered queries is the same in DuckDB."""
    duck = duckdb.connect()
    for p in Path(SF).iterdir():
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    known = __spark_entry__.queries()
    for name, sql in __spark_entry__.oracle_sql().items():
        if name.startswith(("op11_", "op12_", "op13_")):
            got, want = known[name](spark, SF), duck.sql(sql)
            order = [want.columns.index(c) for c in got.columns]
            assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()), name


@pytest.mark.parametrize("start", COLUMNS)
def test_columns(spark, start):
    known = __spark_entry__.queries()
    (name,) = [n for n in known if n.startswith(start)]
    assert known[name](spark, SF).dtypes[: len(COLUMNS[start])] == COLUMNS[start]
