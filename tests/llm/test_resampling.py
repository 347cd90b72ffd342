"""Importance resampling: n-grams of joined texts and whole results against plain loops, odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm import resampling

ROWS = "doc_id bigint, text string"


def slow_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def slow(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(slow_features(text)[1])
    for text in target:
        t.update(slow_features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        n, found = slow_features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus():
    rnd = random.Random(9)
    pool = ["".join(rnd.choice("abcXYZ09éß日 -'\x7f{") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    text = lambda n: rnd.choice([" ", "\n", ", "]).join(rnd.choice(pool) for _ in range(n))
    rows = [(i, text(rnd.choice([0, 1, 5, 30, 120]))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, text(30_000)), (None, text(40)), (None, None), (-5, text(50))]
    same = text(60)
    rows += [(404, same)] * 120 + [(500 + i, same) for i in range(60)]
    return rows, [text(40) for _ in range(20)] + [None, ""]


def test_query_against_a_loop(spark, tmp_path):
    rows, target = corpus()
    df = spark.createDataFrame(rows, ROWS).withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("part", F.lit(1)).withColumn("n_words", F.lit(0))
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = resampling.op13_batched_importance(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == slow(rows, target)


@pytest.mark.parametrize("step", [1, 7, 100, 1 << 20])
def test_features_do_not_depend_on_the_batches(monkeypatch, step):
    rows, _ = corpus()
    texts = [(t or "").encode() for _, t in rows[:60]]
    monkeypatch.setattr(resampling, "STEP", step)
    words, found = Counter(), [Counter() for _ in texts]
    for owner, row, hits in resampling.features(iter(texts)):
        words.update(owner.tolist())
        for r, b in zip(row.tolist(), hits.tolist()):
            found[r][b] += 1
    for i, text in enumerate(texts):
        n, want = slow_features(text.decode())
        assert words[i] == n and found[i] == Counter(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL(ROWS))
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c d " * 20), (3, "e f " * 20), (4, "g h " * 20), (5, "x")], ROWS)
    assert resampling.resampled(empty, some).count() == 0
    got = resampling.resampled(some, empty).collect()
    assert len(got) == 5 and [r.rank for r in got if r.rank] == [1]
