"""Principal component and pillar scores against plain numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatgrid.operators import vulnerability


def test_first_component_matches_numpy(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        a = rnd.gauss(0, 1)
        rows.append((i, a, 0.8 * a + rnd.gauss(0, 0.3), rnd.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").withColumn("score", F.col("a") + F.col("b"))
    out, share = vulnerability.first_component(df, ["a", "b", "c"], "score", "pc")
    x = np.array([r[1:] for r in rows])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ vt[0]
    if np.corrcoef(want, x[:, 0] + x[:, 1])[0, 1] < 0:
        want = -want
    got = np.array([r.pc for r in out.orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-8)
    assert share == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_pillars_use_what_is_there(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 10.0, 4.0), (3, 5.0, 2.0)], "id int, a double, b double")
    out = vulnerability.composite(df, {"p": {"a": 1, "b": -1}}, {"p": 1.0}).orderBy("id").collect()
    assert [r.pillar_p for r in out] == [0.0, 0.5, 0.75]
