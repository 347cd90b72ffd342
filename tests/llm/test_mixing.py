"""Soft mixing: posteriors and rates against plain loops, totals against the targets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatgrid.llm import mixing

RND = random.Random(12)
COMMON = [f"w{i}" for i in range(60)]
BUDGET = 0.6
OWN = {n: [f"{n}{i}" for i in range(15)] for n in mixing.SHARES}


def text(domain, n):
    return " ".join(RND.choice(OWN[domain] if RND.random() < 0.3 else COMMON) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, text(d, RND.choice([3, 20, 150])), d) for i, d in enumerate(RND.choices(list(OWN), [5, 3, 2], k=400))]
    docs = spark.createDataFrame([(i, t, "c", 1.5) for i, t, _ in rows] + [(None, "w1 w2", "c", 0.0), (900, None, "c", 0.0), (901, "", "c", 0.0), (7, rows[7][1], "c", 1.5)], "doc_id bigint, text string, p string, rate double").repartition(3)
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows if i % 2] + [(None, "good"), (3, None), (4, "other"), (900, "poor")], "doc_id bigint, domain string")
    return rows, docs, labelled


def test_posteriors_and_rates(spark, corpus):
    rows, docs, labelled = corpus
    names = sorted(mixing.SHARES)
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in [*COMMON, *sum(OWN.values(), [])]], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    table, prior = np.full((3, mixing.BUCKETS), 0.5), np.full(3, 0.5)
    for i, t, d in rows:
        if i % 2:
            prior[names.index(d)] += 1
            for w in t.split():
                table[names.index(d), bucket[w]] += 2 if i == 7 else 1  # the repeated row counts twice
    prior[names.index("poor")] += 1
    logs = np.log(table / table.sum(axis=1, keepdims=True))

    def soft(t):
        w = (t or "").split()
        z = np.log(prior / prior.sum()) + (logs[:, [bucket[x] for x in w]].sum(axis=1) * min(len(w), mixing.EVIDENCE) / len(w) if w else 0)
        e = np.exp(z - z.max())
        return e / e.sum()

    all_rows = [(i, t) for i, t, _ in rows] + [(None, "w1 w2"), (900, None), (901, ""), (7, rows[7][1])]
    p, n = np.array([soft(t) for _, t in all_rows]), np.array([len((t or "").split()) for _, t in all_rows])
    got = mixing.rates(docs, labelled, budget=BUDGET).collect()
    assert len(got) == len(all_rows)
    key = lambda r: (str(r[0]), r[1])
    want = sorted((str(i), int(n[k]), *p[k]) for k, (i, _) in enumerate(all_rows))
    mine = sorted((str(r.doc_id), r.n_tokens, *[r[f"p_{x}"] for x in names]) for r in got)
    for a, b in zip(mine, want):
        assert key(a) == key(b) and a[2:] == pytest.approx(b[2:], abs=1e-9)
    target = np.array([mixing.SHARES[x] for x in names]) * BUDGET * n.sum()
    totals = [sum(r.rate * r.n_tokens * r[f"p_{x}"] for r in got) for x in names]
    assert totals == pytest.approx(target, rel=1e-5) and min(r.rate for r in got) >= 0

    r, gram = np.full(len(n), BUDGET), (p * n[:, None]).T @ p
    for _ in range(mixing.ROUNDS):
        r = np.maximum(0, r - p @ np.linalg.solve(gram, (r * n) @ p - target))
    assert sorted(x.rate for x in got) == pytest.approx(sorted(r), abs=1e-5)


def test_hard_targets_are_projected(spark, corpus):
    _, docs, labelled = corpus
    got = mixing.rates(docs, labelled, {"good": 1.0, "poor": 0.0, "toxic": 0.0}, 0.9).collect()
    assert min(r.rate for r in got) == 0
    total = sum(r.n_tokens for r in got)
    assert sum(r.rate * r.n_tokens * r.p_good for r in got) == pytest.approx(0.9 * total, rel=0.1)


def test_the_default_asks_for_all_tokens(spark, corpus):
    _, docs, labelled = corpus
    got = mixing.rates(docs, labelled).collect()
    total = sum(r.n_tokens for r in got)
    assert [sum(r.rate * r.n_tokens * r[f"p_{x}"] for r in got) for x in sorted(mixing.SHARES)] == pytest.approx([mixing.SHARES[x] * total for x in sorted(mixing.SHARES)], rel=1e-5)


def test_the_largest_budget_without_repeats(spark, corpus):
    _, docs, labelled = corpus
    found, soft = mixing.fitted(docs, labelled, budget=None)
    rates = [r.rate for r in soft.where("n_tokens > 0").select(found.rate.alias("rate")).collect()]
    assert max(rates) == pytest.approx(1.0) and min(rates) >= 0 and found.converged
    total = soft.agg(F.sum("n_tokens")).first()[0]
    names = sorted(mixing.SHARES)
    want = [mixing.SHARES[n] * found.budget * total for n in names]
    assert list(found.targets) == pytest.approx(want) and list(found.totals) == pytest.approx(want, rel=1e-5)
    given = mixing.fitted(docs, labelled, budget=found.budget)[0]  # the same fit, asked for by its number
    assert sorted(r.rate for r in soft.select(given.rate.alias("rate")).collect()) == pytest.approx(sorted(r.rate for r in soft.select(found.rate.alias("rate")).collect()), abs=1e-5)
    copies = mixing.mixed(docs, labelled, budget=None).groupBy("doc_id", "text").count().where("doc_id IS NOT NULL AND doc_id <> 7").agg(F.max("count")).first()[0]
    assert copies == 1


def test_a_fit_says_whether_it_reached_its_targets(spark, corpus):
    _, docs, labelled = corpus
    found, _ = mixing.fitted(docs, labelled, {"good": 1.0, "poor": 0.0, "toxic": 0.0}, 0.9)
    assert not found.converged and np.abs(found.totals - found.targets).max() > 0


def test_mixed_rows(spark, corpus):
    rows, docs, labelled = corpus
    out = mixing.mixed(docs, labelled, budget=BUDGET)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    kept = out.collect()
    assert 0.4 * len(rows) < len(kept) < 0.8 * len(rows) and sorted(map(str, kept)) == sorted(map(str, out.collect()))
    twice = mixing.mixed(docs, labelled, budget=2.5).count()
    assert 2 * len(rows) < twice < 3 * len(rows)


def test_no_rows_and_no_labels(spark, corpus):
    _, docs, labelled = corpus
    assert mixing.rates(docs.limit(0), labelled).count() == 0 and mixing.mixed(docs.limit(0), labelled).count() == 0
    assert all(r.rate >= 0 for r in mixing.rates(docs, labelled.limit(0)).collect())
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert [r.domain for r in mixing.domains(labels).collect()] == ["toxic", "good", "poor", None, "good"]
