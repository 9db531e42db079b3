"""Registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from disputeflow.plans import oracles
from disputeflow.plans.queries import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry()
SLOW = {"random_forest", "boosted_trees"}  # 300 trees each; test_models.py fits smaller ones


@pytest.fixture(scope="module")
def oracle(spark):
    return oracles.oracle_sql(), connect(SF)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, oracle, name):
    sql, con = oracle
    frame = QUERIES[name](spark, SF)
    if name in sql:
        assert difference(frame, con, sql[name]) is None
    else:
        assert frame.count() > 0


def test_every_twin_has_a_query(oracle):
    assert set(oracle[0]) <= set(QUERIES)


def test_registered():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(oracles.oracle_sql()) <= set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["risk_level", "transactions", "disputes", "amount"]
    assert frame.count() > 0


def test_scans_read_only_what_they_need(spark, capsys):
    QUERIES["dispute_labels"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,46.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


@pytest.mark.parametrize(
    "name",
    ["risk_by_band", "feature_table", "split_70_15_15", "model_evaluations", "threshold_sweep",
     "retrieval_padded", "investigation_reports", "report_documents", "audit_records"],
)
def test_no_pairing_joins_and_no_python(spark, capsys, name):
    QUERIES[name](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert slow not in plan
