"""Quality rules against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter

from heatgrid.llm import quality

GAP = re.compile(r"[\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    w = [x for x in GAP.split(text) if x]
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_and_verdicts(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "a " * 30, "x\ny\nx\n\n \n \nx", "é#*$%&|<>é " * 3, "one two three four five six seven eight nine ten", "w\vx\fy\rz"]
    texts += [" ".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 60))) for _ in range(80)] + ["big " * 50000]
    rows = [(None if i == 5 else i % 70, t, rnd.choice(["h1", "h2", None, ""]), i, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words int, kept string")
    got = {r.row.n_words: r for r in quality.judged(df).collect()}
    failed = {}
    for doc_id, text, source, i, _ in rows:
        r, want = got[i], slow_counts(text)
        assert tuple(r[c] for c in quality.COUNTS) == want, text
        failed[i] = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed[i] and r.row.doc_id == doc_id
    n, k = Counter(r[2] for r in rows if r[2] is not None), Counter(r[2] for r in rows if r[2] is not None and failed[r[3]])
    m, total = sum(k.values()) / sum(n.values()), sum(n.values())
    spread = sum(n[h] * (k[h] / n[h] - m) ** 2 for h in n) - m * (1 - m) * (len(n) - 1)
    rho = spread / (m * (1 - m) * (total - sum(x * x for x in n.values()) / total - (len(n) - 1)))
    weight = 1e6 if rho <= 0 else min(1e6, max(1.0, (1 - rho) / rho))
    for _, _, source, i, _ in rows:
        rate = None if source is None else (k[source] + m * weight) / (n[source] + weight)
        assert (got[i].host_rate is None) == (rate is None) and (rate is None or abs(got[i].host_rate - rate) < 1e-9)
        assert got[i].kept == (not failed[i] and (rate is None or rate <= 0.5))
    kept = quality.passing(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got.values())


def test_a_bad_host_goes_and_a_small_one_is_pulled_to_the_mean(spark):
    per = spark.createDataFrame([("good", 900, 18), ("good2", 800, 10), ("bad", 500, 450), ("tiny", 1, 1)], "source string, n bigint, failed bigint")
    rate = {r.source: r.rate for r in quality.host_rates(per).collect()}
    assert rate["bad"] > 0.8 and rate["good"] < 0.05 and rate["tiny"] < 0.9


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert quality.judged(df).count() == 0 and quality.passing(df).count() == 0
