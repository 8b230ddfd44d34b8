"""Every registered query against its SQL on the smallest driver tables."""

import os

import oracle
import pytest
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries(), oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, note = oracle.compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_every_query_has_an_oracle():
    from pactlens.plans import registry

    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_summary_lines_equal_sql_where_a_headline_is_too_long_for_a_line(spark, tmp_path):
    """Four categories make a headline of over 100 characters, which no line may have."""
    import duckdb

    text = "Licensed under the MIT. token = abcdefabcdefabcdef for the intention of law, write to bob@mail.org and thank the agent"
    spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, note = oracle.compare(spark, con, QUERIES["summary_lines"], ORACLES["summary_lines"], str(tmp_path))
    found = {r.doc_id: r for r in QUERIES["summary_lines"](spark, str(tmp_path)).collect()}
    assert ok, note
    assert len(found[1].headline) > 100 and not found[1].lines_ok and found[2].lines_ok


def test_doc_rollup_equals_sql_on_blank_unmasked_and_korean_documents(spark, tmp_path):
    """Blank documents, those in which masking leaves something, and matches that an earlier placeholder or a name moves."""
    import duckdb
    from pactlens.constants import MASKING_FAILED_WARNING

    notice = "Licensed under the MIT. "
    card = "1234567812345678A1234567"  # what follows the card looks like a passport once the card is masked, and its step is over
    ready, failed = (1, 1, "", "ready_for_review"), (0, 0, MASKING_FAILED_WARNING, "needs_review")
    cases = {
        " \n　": (1, 0, "CLAUSE_EMPTY", "needs_review"),
        None: (1, 0, "CLAUSE_EMPTY", "needs_review"),
        "x" * 20_001: (1, 0, "CLAUSE_TOO_LONG", "needs_review"),
        f"{notice}{card}": failed,
        f"{notice}{card}{'x' * 20_001}": failed,
        # The exception lies just outside its window, but only if the passport, name or address before it is masked.
        f"{notice}1234561234567A1234567 {'x' * 95} version 3": ready,
        f"{notice}성명: 홍길동 {'x' * 110} version 3": ready,
        f"{notice}고객은 김이이며 {'x' * 107} version 3": ready,
        f"{notice}주소: 서울시 길. {'x' * 107} version 3": ready,
        f"{notice}고객은 은행이며 {'x' * 107} version 3": (1, 0, "", "no_signal"),
        "one\x04two": (1, 0, "", "no_signal"),
    }
    rows = list(enumerate(cases))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, note = oracle.compare(spark, con, QUERIES["doc_rollup"], ORACLES["doc_rollup"], str(tmp_path))
    got = {r.doc_id: (r.clause_count, r.finding_count, r.warnings, r.disposition) for r in QUERIES["doc_rollup"](spark, str(tmp_path)).collect()}
    assert ok, note
    assert [got[i] for i, _ in rows] == list(cases.values())
