"""Shards of the k-d tree against a plain recursion."""

from __future__ import annotations

import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from heatgrid.llm import sharding


def slow_tree(rows, k, spans, node=0):
    """rows: (doc_id, size, crc, axes); a list of (row, leaf)."""
    if k == 1:
        return [(r, node) for r in rows]
    spread = [(max(r[3][a] for r in rows) - min(r[3][a] for r in rows)) / spans[a] for a in range(3)]
    a = spread.index(max(spread))
    rows = sorted(rows, key=lambda r: (r[3][a], r[2], -1 if r[0] is None else r[0]))
    total, half, before, left, right = sum(r[1] for r in rows), k // 2, 0, [], []
    for r in rows:
        (right if (2 * before + r[1]) * k > 2 * total * half else left).append(r)
        before += r[1]
    return slow_tree(left, half, spans, node) + slow_tree(right, k - half, spans, node + half)


@pytest.mark.parametrize("how", [{"shards": 8}, {"shards": 5}, {"shards": None, "target_bytes": 20_000}])
def test_shards(spark, how):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["", None, "é", "copy " * 300]) if i % 3 == 0 else "w " * rnd.randrange(1, 400), rnd.choice(["en", "de", None]), rnd.choice(["hot"] * 5 + [f"s{k}" for k in range(9)] + [None])) for i in range(300)]
    rows.append((None, "no id", "en", "hot"))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, size int, node string").repartition(5)
    got = sharding.shard(df, **how).collect()
    code = lambda s: crc32((s or "").encode()) if s is not None else 0
    plain = [(i, len((t or "").encode()) + 1, crc32((t or "").encode()), (len((t or "").encode()) + 1, code(s), code(g))) for i, t, g, s in rows]
    spans = [max(1, max(r[3][a] for r in plain) - min(r[3][a] for r in plain)) for a in range(3)]
    k = how["shards"] or -(-sum(r[1] for r in plain) // how["target_bytes"])
    want = sorted((str(r[0]), r[1], r[2], leaf) for r, leaf in slow_tree(plain, k, spans))
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in got) == want
    bytes_, slots = defaultdict(int), defaultdict(list)
    for r in got:
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(bytes_) == k and max(bytes_.values()) - min(bytes_.values()) <= 2 * max(r[1] for r in plain)


def test_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "en", "s")] * 6 + [(2, None, None, None)], "doc_id bigint, text string, lang string, source string")
    got = sharding.shard(df, shards=2).collect()
    assert sorted(r.doc_id for r in got) == [1] * 6 + [2] and {r.shard for r in got} == {0, 1}
    assert sharding.shard(df.limit(0)).count() == 0


def test_sizes_beyond_64_bits(spark):
    """10^14 bytes in 781,250 leaves: the products of a node's bytes and leaves pass 2^63."""
    rows = spark.createDataFrame([(0, 5, 10**14, 781_250), (6 * 10**13, 10**9, 10**14, 781_250), (5 * 10**13 - 5, 10, 10**14, 781_250)], "before bigint, size bigint, bytes bigint, left int")
    got = [r[0] for r in rows.select(sharding.goes_right(F.floor(F.col("left") / 2).cast("int"))).collect()]
    assert got == [(2 * b + s) * n > 2 * t * (n // 2) for b, s, t, n in [(0, 5, 10**14, 781_250), (6 * 10**13, 10**9, 10**14, 781_250), (5 * 10**13 - 5, 10, 10**14, 781_250)]]


def test_target_bytes_of_large_documents(spark):
    """Leaves of 128 MB over 13 TB in few rows: every leaf holds a row at most, and the tree ends."""
    rows = spark.createDataFrame([(i, 2 * 10**11 + i, i, i, i % 3, i % 2) for i in range(64)], "doc_id bigint, size bigint, text_crc32 bigint, axis0 bigint, axis1 bigint, axis2 bigint")
    got = sharding.leaves(rows, None, 2 * 10**11).groupBy("node").count().collect()
    assert sum(r["count"] for r in got) == 64 and max(r["count"] for r in got) <= 2
