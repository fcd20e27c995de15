"""Exams meet a bank whose rows are far larger than its file: it is never broadcast, and what exams ask for is dealt by rows."""
import pytest

from evalspark.catalog import load_all
from evalspark.operators import exams as E
from evalspark.sources import fixtures as fx


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("exams"))
    kinds = ["SMALL", "MEDIUM", "LARGE", "STANDARD", "ECONOMY"]
    part = [(k, f"name {k % 70}", f"Brand#{k % 3}", kinds[k % 5], k % 37, float(k)) for k in range(1, 400)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k, f"s{k}") for k in range(1, 40)], "s_suppkey long, s_name string").write.parquet(f"{d}/supplier.parquet")
    return d


@pytest.mark.parametrize("name", ["x9_quality_gate", "x10_points_for", "x11_snapshot_check", "u4_required_minus_covered"])
def test_the_bank_is_not_broadcast(spark, tables, name):
    """the planner goes by the size of the file and would send the whole bank to the driver."""
    plan = load_all()[0][name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [question_id" in plan
    assert "BroadcastHashJoin [question_id" not in plan and "BroadcastHashJoin [exam_id" not in plan


def test_what_exams_ask_for_is_dealt_by_rows(spark, tables, monkeypatch):
    bank, bp = fx.item_bank(spark, tables), fx.blueprints(spark, tables)
    whole = E.assemble_by_type(bank, bp)
    assert "BroadcastHashJoin [topic#" not in whole._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin [topic#")[0]
    rows = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(E, "ASKED", 5)
    small = E.assemble_by_type(bank, bp)
    assert "REPARTITION_BY_NUM" in small._jdf.queryExecution().executedPlan().toString()
    assert rows and sorted(map(tuple, small.collect())) == rows
