"""Kneser-Ney toxicity: probabilities against plain loops, held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from heatgrid.llm import toxicity as tox
from heatgrid.session import cut_lineage

RND = random.Random(5)
POOL = ["".join(RND.choice("aeinrst") for _ in range(RND.randrange(2, 8))) for _ in range(400)]
BAD = ["vile", "rotten", "nasty", "foul"]


def text(n, bad):
    out = [RND.choice(POOL) for _ in range(n)]
    for _ in range(n // 20 if bad else 0):
        out[RND.randrange(n)] = RND.choice(BAD)
    return " ".join(out).capitalize() + "."


def rows(n=1200):
    return [(i, text(RND.choice([40, 120, 300]), i % 4 == 0), int(i % 4 == 0)) for i in range(n)]


@pytest.fixture(scope="module")
def learned(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, i % 7, "x") for i, t, _ in data], "doc_id bigint, text string, score int, n string").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id bigint, quality int, toxic int")
    return data, docs, labels


def test_model_equals_plain_counts(spark, learned):
    data, docs, labels = learned
    chosen, scale = tox.learning_rows(labels)
    assert not set(chosen) & set(scale) and all(crc32(str(i).encode()) % 3 != 1 for i in [*chosen, *scale])
    assert sum(chosen.values()) * 2 == len(chosen)
    plain = docs.selectExpr("doc_id", "cast(text as binary) AS text")
    fitted = tox.model(cut_lineage(tox.counts(plain, chosen)))
    follows, uses, every = [defaultdict(set), defaultdict(set)], [defaultdict(Counter), defaultdict(Counter)], Counter()
    for i, t, _ in data:
        w = tox.split(t.encode())
        every.update(w)
        if i in chosen:
            c = 1 - chosen[i]
            for a, b in zip([None, *w], w):
                follows[c][b].add(a)
                uses[c][a][b] += 1
    d = tox.DISCOUNT
    base = lambda b: (1 + every[b]) / (len(every) + sum(every.values()))

    def p(c, a, b):
        total = sum(map(len, follows[c].values()))
        rest = 1 - sum(max(len(x) - d, 0) for x in follows[c].values()) / total
        word = max(len(follows[c][b]) - d, 0) / total + rest * base(b)
        n = sum(uses[c][a].values())
        back = sum(min(x, d) for x in uses[c][a].values()) / n if n else 1
        return (max(uses[c][a][b] - d, 0) / n if n else 0) + back * word

    places = tox.Places(fitted.keys)
    for i, t, _ in data[:40]:
        w = tox.split(t.encode())
        want = sum(math.log(p(0, a, b) / p(1, a, b)) for a, b in zip([None, *w], w)) / len(w)
        assert fitted.evidence(places.of(t.encode()))[0] == pytest.approx(want, abs=2e-3)
    for c in (0, 1):  # the shared counts and the discounts leave a whole distribution
        for a in (None, "vile".encode(), POOL[0].encode()):
            assert sum(p(c, a, b) for b in every) == pytest.approx(1, abs=1e-9)


def test_model_does_not_depend_on_how_tasks_hand_on(spark, learned, monkeypatch):
    _, docs, labels = learned
    chosen, _ = tox.learning_rows(labels)
    plain = docs.selectExpr("doc_id", "cast(text as binary) AS text")
    whole = sorted(map(str, tox.counts(plain, chosen).collect()))
    monkeypatch.setattr(tox, "HELD", 50)
    assert sorted(map(str, tox.counts(plain.repartition(3), chosen).collect())) == whole


def test_held_out_rows(spark, learned):
    data, docs, labels = learned
    got = {r.doc_id: r for r in tox.score(docs, labels).collect()}
    assert len(got) == len(data)
    for i, _, _ in data:
        assert got[i].held_out == (crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.7)
    held = [(got[i].predicted, y) for i, _, y in data if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_odd_rows(spark, learned):
    _, docs, labels = learned
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " .,;"), (None, "some text"), (-4, "same words"), (-4, "same words"), (-5, "a " * 100000)], "doc_id bigint, text string")
    got = tox.score(docs.select("doc_id", "text").union(odd), labels).where("doc_id IS NULL OR doc_id < 0").collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    none = tox.score(odd, labels.limit(0)).collect()
    assert len(none) == 7 and all(r.score == 0.5 and r.predicted == 0 for r in none)
    assert tox.score(docs.limit(0), labels).count() == 0
