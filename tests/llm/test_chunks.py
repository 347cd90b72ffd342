"""Content-defined chunks: stable cuts, repeats against a plain search, texts cut right."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from heatgrid.llm import chunks

RND = random.Random(11)
POOL = ["".join(RND.choice("abcdefghiköéß日") for _ in range(RND.randrange(1, 10))) for _ in range(3000)]


def prose(n):
    return " ".join(RND.choice(POOL) for _ in range(n))


def test_gear_is_the_rolling_hash():
    raw = np.frombuffer(prose(50).encode(), dtype=np.uint8)
    h = chunks.gear(raw)
    for i in range(len(raw)):
        want = sum(int(chunks.GEAR[raw[i - k]]) << k for k in range(min(16, i + 1))) % 2**32
        assert int(h[i]) == want
    low = [i for i in range(len(h)) if all(h[i] <= h[j] for j in range(max(0, i - chunks.REACH), min(len(h), i + chunks.REACH + 1)))]
    assert chunks.lowest(h).tolist() == low


def test_chunks_cover_the_text_and_resist_insertions():
    for text in ["", " ", "x", "one two", "a" * 5000, "日" * 700, "na " * 900, prose(3000), " \n" * 300 + prose(20)]:
        raw, at = text.encode(), 0
        for start, size, words, _ in chunks.split(raw):
            assert not raw[at:start].strip() and size > 0
            assert words >= 1
            raw[start : start + size].decode()
            at = start + size
        assert not raw[at:].strip()
        assert sum(c[2] for c in chunks.split(raw)) >= len(text.split())
    text = prose(3000)
    a, b = ({c[3] for c in chunks.split(t.encode())} for t in (text, f"{text[:4000]}, just inserted, {text[4000:]}"))
    assert len(a ^ b) <= 10 and len(a & b) > 100


def test_cuts_do_not_depend_on_slices(monkeypatch):
    raw = prose(4000).encode()
    want = chunks.split(raw)
    monkeypatch.setattr(chunks, "SLICE", 1000)
    assert chunks.split(raw) == want


def slow_repeats(rows, least):
    held, out = defaultdict(set), set()
    cut = [(i, n, c) for i, t in rows if i is not None and t is not None for n, c in enumerate(chunks.split(t.encode()))]
    for i, _, c in cut:
        held[c[3]].add(i)
    by_doc = defaultdict(dict)
    for i, n, c in cut:
        if min(held[c[3]]) != i:
            by_doc[i][n] = c
    for i, found in by_doc.items():
        run = []
        for n in sorted(found):
            if run and n != run[-1] + 1:
                out.add((i, found[run[0]][0], found[run[-1]][0] + found[run[-1]][1], sum(found[k][2] for k in run)))
                run = []
            run.append(n)
        out.add((i, found[run[0]][0], found[run[-1]][0] + found[run[-1]][1], sum(found[k][2] for k in run)))
    return {(i, a, b - a, w) for i, a, b, w in out if w >= least}


def test_repeats_and_cut_texts(spark):
    passage, other = prose(55), prose(80)
    rows = [(i, prose(RND.randrange(20, 200))) for i in range(40)]
    rows += [(100 + i, f"{prose(40)} {passage} {prose(30)}") for i in range(12)] + [(200, f"{other} {prose(20)} {passage}"), (201, f"{prose(9)}\n{other}"), (202, f"{other} {other}")]
    rows += [(300, rows[3][1]), (301, ""), (302, None), (None, passage), (303, passage), (40, f"{prose(30)} {rows[7][1]}"), (203, "tick " * 200), (204, "tick " * 300)]
    df = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "doc_id bigint, text string, n_chars int, chunk string, words int").repartition(4)
    got = chunks.repeats(df).collect()
    assert {(r.doc_id, r.start, r.length, r.words) for r in got} == slow_repeats(rows, chunks.MIN_WORDS)
    hit = Counter(r.doc_id for r in got)
    assert {*range(101, 112), 200, 201, 202, 300, 303, 40, 204} == set(hit)
    assert next(r for r in got if r.doc_id == 101).first_doc_id == 100
    out = chunks.without_repeats(df)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    text, spans = dict(rows), defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.start + r.length))
    for r in out.collect():
        want = text[r.doc_id]
        if want is not None:
            raw = want.encode()
            for a, b in sorted(spans[r.doc_id] if r.doc_id is not None else [], reverse=True):
                raw = raw[:a] + raw[b:]
            want = raw.decode()
        assert r.text == want and r.n_chars == (None if want is None else len(want))
    assert out.count() == len(rows)


def test_repeated_ids_and_no_rows(spark):
    text = prose(100)
    df = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id bigint, text string")
    assert chunks.repeats(df).count() == 0
    assert sorted(r.text for r in chunks.without_repeats(df).collect()) == sorted([text, text, "short"])
    assert chunks.repeats(df.limit(0)).count() == 0 and chunks.without_repeats(df.limit(0)).count() == 0


def hits(rows, spark):
    return {r.doc_id for r in chunks.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_passages_wrapped_otherwise_or_without_spaces(spark):
    rnd, rows = random.Random(21), []
    wrap = lambda words, n, gap: gap.join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    for n in range(60):
        words = prose(70).split()
        rows += [(10 * n, f"{prose(40)} {' '.join(words)} {prose(40)}"), (10 * n + 1, f"{prose(30)}\n{wrap(words, rnd.choice([5, 8, 12]), rnd.choice([chr(10), '  ', chr(13) + chr(10)]))}\n\n{prose(30)}")]
    plain = lambda k: "".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(k))
    for n in range(60, 110):
        passage = plain(400)
        rows += [(10 * n, plain(300) + passage + plain(200)), (10 * n + 1, plain(250) + passage + plain(300))]
    for n in range(110, 160):
        rows += [(10 * n, plain(300)), (10 * n + 1, plain(300))]
    found = hits(rows, spark)
    wrapped, solid = (sum(10 * n + 1 in found for n in part) for part in (range(60), range(60, 110)))
    assert wrapped >= 59 and solid >= 49, (wrapped, solid)
    assert not [i for i in found if i >= 1100 or i % 10 == 0]


def test_one_doc_id_with_two_texts(spark):
    shared, other = prose(90), prose(90)
    rows = [(1, shared, "a"), (5, f"{prose(10)} {shared}", "b"), (5, other, "c"), (5, f"{other} {prose(3)}", "d"), (5, None, "e")]
    out = chunks.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, cut string").withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).withColumn("tag", F.lit(3)))
    assert out.columns == ["doc_id", "text", "cut", "row", "key", "tag"]
    kept = {r.cut: r.text for r in out.collect()}
    assert kept["a"] == shared and kept["c"] == other and kept["d"] == rows[3][1] and kept["e"] is None and len(kept["b"]) < len(rows[1][1]) / 2
