"""Spelling variants: neighbourhoods against all edits, results against all pairs, odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm import spelling

ROWS = "doc_id bigint, text string"


def edits(symbols):
    """Every string that one edit or none makes of a list of symbols."""
    out, every = {tuple(symbols)}, range(spelling.SYMBOLS)
    for i in range(len(symbols) + 1):
        out |= {tuple(symbols[:i] + [c] + symbols[i:]) for c in every}
        if i < len(symbols):
            out |= {tuple(symbols[:i] + symbols[i + 1 :])} | {tuple(symbols[:i] + [c] + symbols[i + 1 :]) for c in every}
    return out


def value(symbols):
    h = 0
    for c in symbols:
        h = (h * int(spelling._BASE) + int(spelling._VALUES[c])) % 2**64
    return h


def short(symbols):
    """The upper half of the hash, signed."""
    x = value(symbols) >> 32
    return x - (1 << 32) if x >> 31 else x


def test_neighbourhoods_hold_each_edit_once(monkeypatch):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aabcdeéÿz") for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    reduced = [spelling.SYMBOL[list(w.encode("latin-1"))].tolist() for w in words]
    for step in (spelling.STEP, 4):  # the second cuts words into slices
        monkeypatch.setattr(spelling, "STEP", step)
        found = [[] for _ in words]
        for which, keys in spelling.neighbourhoods(words):
            for w, k in zip(which.tolist(), keys.tolist()):
                found[w].append(k)
        for symbols, keys in zip(reduced, found):
            assert len(keys) == len(set(keys)) and set(keys) == {short(s) for s in edits(symbols)}
        assert spelling.codes(words).tolist() == [short(s) for s in reduced]
    full = [h for _, keys in spelling._edits(np.array(reduced[:1])) for h in keys.tolist()]
    assert len(full) == len(set(full)) == len(edits(reduced[0])) and set(full) == {value(s) for s in edits(reduced[0])}


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) > len(v):
        u, v = v, u
    i = next((i for i in range(len(u)) if u[i] != v[i]), len(u))
    return u[i:] == v[i + 1 :] if len(u) < len(v) else u[i + 1 :] == v[i + 1 :]


def slow(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(near), form, n.get(form))
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return sorted((w, *out[w], root(w)) for w in out)


def test_query_against_all_pairs(spark, tmp_path):
    rnd = random.Random(8)
    stems = ["".join(rnd.choice("aeiourtnsßéÀ") for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    pool = []
    for stem in stems:
        for _ in range(rnd.choice([1, 3, 6])):
            i = rnd.randrange(len(stem))
            pool += [stem] * 4 + [rnd.choice([stem[:i] + stem[i + 1 :], stem[:i] + rnd.choice("aeßz") + stem[i:], stem[:i] + "o" + stem[i + 1 :]])]
    long = "".join(rnd.choice("abc") for _ in range(5000))
    chain = [("lettter", 3), ("letter", 6), ("lettes", 12), ("lattes", 24), ("latte", 48), ("tieaa", 3), ("tieab", 3), ("tieac", 3)]
    rows = [(i, " ".join(rnd.choice(pool).upper() if rnd.random() < 0.1 else rnd.choice(pool) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(500 + i, " ".join(w for w, k in chain for _ in range(k) if i == 0)) for i in range(2)]
    rows += [(600 + i, f"{long} {long[:2500]}z{long[2501:]}, {long[1:]}") for i in range(4)]
    rows += [(7, "repeated rows count"), (7, "repeated rows count"), (7, "repeated rows count"), (None, "nameless nameless nameless"), (8, None), (9, ""), (10, "1234 日本語 x" * 20)]
    rows += [(700 + i, "abcdef " * 2) for i in range(400)]
    df = spark.createDataFrame(rows, ROWS).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2)).withColumn("form", F.lit("f"))
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.op12_reduced_alphabet(spark, str(tmp_path)).collect())
    want = slow(rows)
    assert [w for w in got if w[0] in ("lettter", "letter", "lettes", "lattes")] and {w[5] for w in got if w[0] == "lettter"} == {"latte"}
    assert got == want and len(got) > 150 and any(len(w[0]) > 4000 and w[1] for w in got)


def test_long_texts_are_counted_in_slices(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abCé -\n1") for _ in range(20_000)) + "x" * 300
    want = spelling.runs(text)
    monkeypatch.setattr(spelling, "STEP", 50)
    assert spelling.runs(text) == want and want["x" * 300] <= 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL(ROWS))
    assert spelling.spelling_variants(empty).count() == 0


def test_neighbourhoods_are_not_broadcast(spark, tmp_path):
    """Written words of a few KB have neighbourhoods a hundred times as large, which the plan does not know."""
    spark.createDataFrame([(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", 3) for i in range(500)], "word string, n bigint").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "10m")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (spelling.near(words), spelling.variants(words))]
    finally:
        spark.conf.set(key, old)
    assert all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in plans)
