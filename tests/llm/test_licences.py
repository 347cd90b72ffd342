"""Licence notices against plain loops over all windows."""

from __future__ import annotations

import random
import re

import pytest

from heatgrid.llm import licences as lic

PLAIN = re.compile(r"[^a-z0-9]+")
SIZES = [(name, lic.pairs_of(text)) for name, text in lic.TEMPLATES]
LARGEST = max(len(p) for _, p in SIZES)


def pairs(text):
    w = PLAIN.sub(" ", (text or "").lower()).split()
    return list(zip(w, w[1:]))


def slow_scan(rows, templates):
    """The operator's own rule: windows from each pair of a template on, overlapping ones as one notice."""
    known = [(name, lic.pairs_of(t)) for name, t in templates]
    largest = max((len(p) for _, p in known), default=1)
    out = {}
    for doc_id, text in rows:
        p, good = pairs(text), {}
        for name, t in known:
            hits = [i for i, x in enumerate(p) if x in set(t)]
            for i in hits:
                best, end = 0.0, -1
                for frame in lic.FRAMES:
                    inside = [j for j in hits if j >= i and j / len(t) <= i / len(t) + lic.reach(frame, largest)]
                    shared = len({p[j] for j in inside})
                    dice = 2 * shared / (len(t) + inside[-1] - i + 1 - (len(inside) - shared))
                    best, end = max(best, dice), max(end, inside[-1] if dice >= lic.MIN_DICE else -1)
                if best >= lic.MIN_DICE:
                    good.setdefault(name, []).append((i, end, best))
        for name, found in good.items():
            top, n = out.get((doc_id, name), (0, 0))
            last = -1
            for i, end, dice in sorted(found):
                n, last, top = n + (i > last), max(last, end), max(top, dice)
            out[doc_id, name] = top, n
    return {k: (round(d, 6), n) for k, (d, n) in out.items()}


def sliding(text, t):
    """Best Dice coefficient of all windows of a text, distinct pairs on both sides."""
    p, t = pairs(text), set(t)
    best = 0.0
    for i in range(len(p)):
        seen, shared = set(), 0
        for x in p[i : i + int(len(t) / lic.MIN_DICE * (2 - lic.MIN_DICE)) + 1]:
            if x not in seen:
                seen.add(x)
                shared += x in t
            best = max(best, 2 * shared / (len(seen) + len(t)))
    return best


def corpus(rnd):
    pool = "this work is licensed under the general public terms of a version and some other words here".split()
    other = "see the notes about our code which was written in spring and reviewed twice by people who like short names".split()
    more = lambda n: " ".join(rnd.choice(other) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, "mit"), (5, "Released under the MIT License."), (5, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (None, None)]
    rows += [(6, "Copyright 2020 Jane Doe. Released under the MIT License."), (7, "The code is released under the MIT License."), (8, "Copyright 2020 Acme Inc. Licensed under the Apache License, Version 2.0.")]
    for i, (_, text) in enumerate(lic.TEMPLATES):
        w = text.split(" ")
        rows.append((100 + i, f"{more(9)}\n{text.upper()}\n{more(5)}"))
        rows.append((200 + i, "intro\n\n" + "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4)) + "\n \nend"))
        rows.append((300 + i, f"{more(7)} " + " ".join(x for x in w if rnd.random() > 0.05) + f" {more(7)}"))
        rows.append((400 + i, f"{text} {more(1)} " * 3 if i % 2 else f"{more(6)} {text} {more(11)}"))
        rows.append((500 + i, f"{more(20)} " + " ".join(f"{x} {rnd.choice(other)}" if rnd.random() < 0.05 else x for x in w)))
    rows += [(600 + i, "\n".join(" ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14))) for _ in range(4))) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def scanned(spark):
    rows = corpus(random.Random(9))
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, template int, licence string, at int").repartition(3)
    return rows, df, lic.scan(df).collect()


def test_scan(scanned):
    rows, df, got = scanned
    assert {(r.doc_id, r.licence): (r.dice, r.notices) for r in got} == slow_scan(rows, lic.TEMPLATES)
    assert len(got) == len({(r.doc_id, r.licence) for r in got})
    assert {(r.doc_id, r.licence) for r in got} >= {(6, "MIT"), (7, "MIT"), (8, "Apache-2.0"), (None, "CC-BY-NC-4.0")}
    assert next(r.notices for r in got if r.doc_id == 5) == 2
    assert lic.scan(df.limit(0)).count() == 0
    assert lic.scan(df, templates=[("none", "word")]).count() == 0


def test_every_window_of_the_text(scanned):
    """Against all windows of all lengths: nothing is reported that no window reaches, and what one reaches is found."""
    rows, _, got = scanned
    found = {(r.doc_id, r.licence): r.dice for r in got}
    wanted = {}
    for doc_id, text in rows:
        for name, t in SIZES:
            best = sliding(text, t)
            if best >= lic.MIN_DICE:
                wanted[doc_id, name] = max(best, wanted.get((doc_id, name), 0))
    assert not set(found) - set(wanted)
    missed = [k for k in wanted if k not in found]
    assert len(missed) <= 0.01 * len(wanted), missed
    assert all(found[k] <= wanted[k] + 1e-6 for k in found)
