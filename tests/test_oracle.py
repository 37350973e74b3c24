"""Every registered query runs; where SQL exists it returns the oracle's rows."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import verify

SMALL = "/root/testdata/sf0.001"
#: queries that SQL cannot express, and the tests that hold their operators against brute force instead
WITHOUT_SQL = {
    "run_field_summary": "test_tables.py::test_whole_run_with_and_without_signal",
    "run_verified": "test_tables.py::test_whole_run_with_and_without_signal",
    "op1_language": "llm/test_operators.py::test_language_learns_and_rejects",
    "op3_pieces": "llm/test_operators.py::test_pieces_equal_the_library",
    "op4_embedding_caps": "llm/test_operators.py::test_caps_match_all_pairs",
    "op5_lm_score": "llm/test_operators.py::test_context_tree_weighting_equals_the_recursion",
    "op7_chat": "llm/test_operators.py::test_chat_reads_back_and_sees_rewriting",
    "op8_url_filter": "llm/test_operators.py::test_propagation_equals_power_iteration",
    "op9_secrets": "llm/test_operators.py::test_secrets_base_and_learned",
    "op10_quality": "llm/test_operators.py::test_quality_counts_equal_brute_force",
    "pipeline": "llm/test_operators.py::test_pipeline_runs_and_keeps_columns",
}


@pytest.fixture(scope="module")
def con():
    return verify.oracle_connection(SMALL)


@pytest.mark.parametrize("key", list(entry.queries()))
def test_query(spark, con, key):
    got = entry.queries()[key](spark, SMALL).toArrow()
    sql = entry.oracle_sql().get(key)
    if sql is None:
        file, name = WITHOUT_SQL[key].split("::")
        assert f"def {name}(" in (Path(__file__).parent / file).read_text()
    else:
        assert verify.compare(got, con.sql(sql).to_arrow_table()) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
