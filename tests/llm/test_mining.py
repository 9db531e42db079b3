"""Hard negatives beside brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputeflow.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, rank string"
NAN, INF = float("nan"), float("inf")


def brute(rows, anchor, positives, negatives, band):
    low, high, base = band
    known = {}
    for vec_id, vector, label, *_ in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        known[vec_id] = min(known.get(vec_id, (label, whole)), (label, whole))
    found = []
    for a, (label, vector) in known.items():
        if not anchor(a):
            continue
        score = {b: sum(x * y for x, y in zip(vector, other)) for b, (_, other) in known.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if known[b][0] == label][:positives]:
            inside = [b for b in order if known[b][0] != label and low * score[p] <= base * score[b] <= high * score[p]]
            found += [(a, p, k, b, score[p], score[b]) for k, b in enumerate(inside[:negatives], 1)]
    return sorted(found)


def test_planes_and_tables_give_inner_products():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-700, 700, (50, 24)), rng.integers(-700, 700, (7, 24))
    rows[0], anchors[0] = -1024, 1023
    assert (hn.scores(hn.planes(rows, 11), hn.tables(anchors)) == rows @ anchors.T).all()


@pytest.mark.parametrize("block, anchors, at_once", [(4096, 2048, 64), (37, 5, 2)])
def test_equals_brute_force(spark, monkeypatch, block, anchors, at_once):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "AT_ONCE", at_once)
    rng = random.Random(3)
    rows = []
    for i in range(400):
        # few values and a label with a third of the rows: many ties
        vector = [rng.choice([-0.3, 0.0, 0.1, 0.25, 1.5]) for _ in range(rng.choice([5, 12, 12, 12]))]
        rows.append((i, vector, rng.choice([0, 0, 0, 1, 2, 3, 4, -7]), "x", "y"))
    rows += [rows[5]] * 30 + [(5, [0.5] * 12, 3, "x", "y"), (17, [], 0, None, None), (900, [], 1, "", "")]
    rows += [(None, [1.0], 1, "x", "y"), (901, None, 1, "x", "y"), (902, [1.0], None, "x", "y"), (910, [1.0, NAN], 0, "x", "y")]
    rows += [(920, [INF], 0, "x", "y"), (930, [None, 1.0], 0, "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = hn.mine(frame, F.col("vec_id") % 10 == 0, positives=3, negatives=4, band=(20, 95, 100))
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows, lambda a: a % 10 == 0, 3, 4, (20, 95, 100))
    assert len(got) > 50


def test_empty_tables_and_large_components(spark):
    frame = spark.createDataFrame([(1, [1.0], 1, "", ""), (2, [2.0], 2, "", "")], SCHEMA)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows, anchor in ((frame.limit(0), F.lit(True)), (frame, F.col("vec_id") > 5), (frame, F.lit(True))):
        found = hn.mine(rows, anchor)
        assert found.columns == columns and found.count() == 0
    assert found.dtypes[2] == ("rank", "int")
    with pytest.raises(ValueError):
        hn.mine(spark.createDataFrame([(1, [3e38], 1, "", "")], SCHEMA), F.lit(True))
