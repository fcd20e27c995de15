"""Every area against its SQL at the smallest scale (tests/oracle_check.py runs all of them)."""
import pytest

from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ("w4_mastery_events", "w6_spacing_intervals", "l5_select_difficulty", "l7_retention_state", "a9_coverage", "t3_pack_chunks",
         "t11_query_terms", "t16_fuzzy_correct", "t20_to_base", "a1_mark_exact_duplicates", "a3_reconcile_vocab", "j5_near_duplicates",
         "j22_evaluation_leakage", "k2_semantic_search", "j13_formula_chains", "j17_check_formula", "j16_verify_claims", "g4_grade_numeric",
         "a10_exam_results", "x12_session_state", "x9_quality_gate", "w9_section_neighbours", "s1_verify_sources", "s6_extract_item_bank", "st6_session_windows")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    import __spark_entry__ as entry
    state, msg, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert state in ("ok", "EMPTY"), msg


def test_names_match():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).limit(1).count() == 1
