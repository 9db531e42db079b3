from __future__ import annotations

import numpy as np
import pytest
from conftest import one, rows
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from disputeflow.operators import selection, statistics


def medians(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    return statistics.exact_medians(frame, ["v"]).first()["median"]


@pytest.mark.parametrize(
    "values, expected",
    [([1, 2, 3, 4], 2.5), ([3, 1, 2], 2), ([5], 5), ([1, None, 9], 5), ([2, 2, 2, 7], 2)],
)
def test_median_small(spark, values, expected):
    assert medians(spark, [None if v is None else float(v) for v in values]) == expected


def test_median_of_nothing(spark):
    assert medians(spark, [None]) is None


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_median_any(spark, values):
    assert medians(spark, values) == pytest.approx(np.median(values), abs=1e-12)


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
       -1.7976931348623157e308, 1.0, 0.9999999999999999, 1.0000000000000002, 2.0, 8.0, 7.999999999999999, -3.5,
       float("inf"), float("-inf"), 0.1, 1e-300, 1e300]


def test_ordered_bits_are_the_bits(spark):
    generator = np.random.default_rng(1)
    random = generator.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64)
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), -powers])
    values = np.concatenate([ODD, random[np.isfinite(random)], near])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = np.array([r["b"] for r in selection.with_ordered_bits(frame, "v", "b").collect()])
    want = np.abs(values).view(np.int64) * np.where(values < 0, -1, 1)
    assert (got == want).all()
    nothing = spark.sql("SELECT double('NaN') AS v UNION ALL SELECT NULL")
    assert [r["bits"] for r in selection.with_ordered_bits(nothing, "v").collect()] == [None, None]


@pytest.mark.parametrize("bins", [selection.BINS, 3])
def test_ranks_of_many_values(spark, monkeypatch, bins):
    """All values distinct, a third of them equal, and odd ones; every round is needed when bins are few."""
    monkeypatch.setattr(selection, "BINS", bins)
    generator = np.random.default_rng(5)
    groups = {
        "distinct": generator.normal(size=30_001), "close": 1.0 + np.arange(20_000) * 2.0**-52,
        "hot": np.concatenate([generator.normal(size=3_000), np.full(1_500, 0.25)]), "odd": np.array(ODD), "one": np.array([7.0]),
    }
    frame = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "group string, value double")
    shares = {share: (lambda n, share=share: F.ceil(n * share)) for share in (0.001, 0.3, 0.5, 1.0)}
    shares["beyond"] = lambda n: n + 1
    got = selection.select_ranks(frame, shares)
    assert set(got) == {(g, s) for g in groups for s in shares if s != "beyond"}
    for (group, share), value in got.items():
        values = np.sort(groups[group])
        assert value == values[int(np.ceil(len(values) * share)) - 1], (group, share)


def test_equal_bits_are_told_apart_by_value(spark):
    frame = spark.createDataFrame([("g", v) for v in "cabbbd"], "group string, value string")
    ranks = {i: (lambda n, i=i: F.lit(i)) for i in range(1, 7)}
    got = selection.select_ranks(frame, ranks, lambda cells, _: cells.withColumn("bits", F.lit(5).cast("bigint")))
    assert [got["g", i] for i in range(1, 7)] == list("abbbcd")


def test_medians_sort_no_values(spark, monkeypatch):
    plans = []
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    collect = Frame.collect
    def seen(self):
        plans.append(self._jdf.queryExecution().toString())
        return collect(self)

    monkeypatch.setattr(Frame, "collect", seen)
    frame = spark.range(100_000).select((F.col("id") * 1.5).alias("v"), F.rand(1).alias("w"))
    got = {r["column_name"]: r["median"] for r in statistics.exact_medians(frame, ["v", "w"]).collect()}
    assert got["v"] == 99_999 * 0.75
    assert len(plans) >= 2
    for plan in plans:
        assert "percentile" not in plan and "Window [" not in plan.split("HashAggregate")[-1]
        # windows are over counts of digits, above the aggregation
        for at, line in enumerate(lines := plan.split("== Physical Plan ==")[-1].splitlines()):
            if "Window" in line:
                assert any("HashAggregate" in below for below in lines[at:])


def test_modes_take_the_smallest_on_a_tie(spark):
    frame = spark.createDataFrame(
        [("b", "z"), ("a", "z"), ("b", None), ("a", "y")], "t string, u string"
    )
    got = {r["column_name"]: (r["mode_value"], r["mode_count"])
           for r in rows(statistics.modes(frame, ["t", "u"]))}
    assert got == {"t": ("a", 2), "u": ("z", 2)}


def test_scaler_uses_population_deviation(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    got = {r["column_name"]: (r["mean"], r["std"])
           for r in rows(statistics.scaler_stats(frame, ["a", "c"]))}
    assert got == {"a": (2.0, 1.0), "c": (5.0, 0.0)}


def test_label_statistics(spark):
    frame = spark.createDataFrame([(0,), (0,), (0,), (1,)], "chargeback_label int")
    summary = one(statistics.label_summary(frame))
    assert (summary["positives"], summary["negatives"]) == (1, 3)
    assert (summary["positive_rate"], summary["imbalance_ratio"]) == (0.25, 3.0)
    weights = {r["chargeback_label"]: r["class_weight"]
               for r in rows(statistics.class_weights(frame))}
    assert weights == {0: pytest.approx(4 / 6), 1: 2.0}


def test_missing_cells(spark):
    frame = spark.createDataFrame([(None, 1.0), ("a", float("nan"))], "t string, v double")
    assert one(statistics.missing_cells(frame)) == {"missing_cells": 2, "row_count": 2}


def test_median_map_makes_no_table(spark, monkeypatch):
    data = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double").localCheckpoint()
    made = []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: made.append(a))
    assert statistics.median_map(data, ["a", "b"]) == {"a": 2.0, "b": None}
    assert statistics.median_map(data, []) == {}
    assert not made
