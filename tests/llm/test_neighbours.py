"""One-bit codes: bounds, recall and exact scores against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from heatgrid.llm import neighbours as nn

SMALL = "/root/testdata/sf0.01"


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if j != i][:k]
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hit / max(1, sum(map(len, want.values())))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables are not there")
def test_recall_on_the_table(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    got = by_query(nn.op5_rotated_codes(spark, SMALL).collect())
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)
    want = brute(ids, x)
    assert set(got) == set(want) and recall(got, want) >= 0.99
    at = {int(i): n for n, i in enumerate(ids)}
    for q, found in got.items():
        assert len(found) == 20 and all(abs(s - float(x[at[q]] @ x[at[v]])) < 1e-12 for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_many_blocks_copies_and_odd_rows(spark):
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((900, 21)) + 0.5
    x[300:600] = x[300]  # copies
    rows = [(int(i), v.tolist(), 1, 0.0) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 21), (2040, [float("nan")] * 21), (2060, [1.0] * 20 + [None]), (2080, [1.0, 2.0]), (2100, [float("inf")] * 21), (None, [1.0] * 21), (2120, []), (5, rows[5][1])]
    df = spark.createDataFrame(rows + [(i, v, 1, 0.0) for i, v in odd], "vec_id bigint, embedding array<float>, rank int, scale double").repartition(4)
    single = x.astype(np.float32).astype(float)
    want = brute(np.arange(900), single)
    got = by_query(nn.search(df, block=128, query_block=10).collect())
    assert set(got) == set(want) and recall(got, want) >= 0.99
    copies = [v for v, _ in got[300]]
    assert copies == [v for v, _ in want[300]]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert {q: [v for v, _ in f] for q, f in by_query(nn.search(df).collect()).items()} == {0: [1, 20], 20: [1, 0]}
    assert nn.search(df.limit(0)).count() == 0
    assert nn.search(df.where("vec_id = 0")).count() == 0 and nn.search(df.where("vec_id = 1")).count() == 0
