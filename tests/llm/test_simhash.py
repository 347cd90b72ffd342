"""Fingerprints and near-duplicate components against plain loops."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm import simhash
from heatgrid.llm.common import components

SCHEMA = "doc_id bigint, text string, fp string, node string"


def slow_fingerprint(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """pairs: (id, value); ids within 4 bits of one another, followed to the end."""
    ids = sorted(pairs)
    root = {i: i for i, _ in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(ids):
        for j, b in ids[:n]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i, _ in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two three", "a b c d", "A b\vC  d\re\f ", "é É à b c d e f", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) % 2**64 == slow_fingerprint(text)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(5, 5), (1000, 1001), (1000, 1001), (-4, 1000)] + [(2000 + i, 2001 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_links_of_scattered_and_crowded_fingerprints(spark):
    rnd = random.Random(7)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    values = {0, 2**64 - 1, *seeds}
    for s in seeds:
        x = s
        for _ in range(6):  # chains of links, and near misses
            x = flip(x, rnd.choice([1, 3, 4, 5]))
            values.add(x)
    crowd = rnd.getrandbits(64)
    values |= {flip(crowd, rnd.choice([1, 2, 3, 5, 6])) for _ in range(400)}
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    got = {r.fp: r.root for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()}
    want = slow_components(list(zip(signed, values)))
    groups = lambda d: {frozenset(k for k in d if d[k] == r) for r in set(d.values())}
    assert set(got) == set(signed)
    assert groups(got) == groups(want)


def test_query_rows(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 8
    rows = [(4, base, "a", "n"), (3, base, "b", None), (9, base + "x", None, ""), (5, None, "", ""), (6, "", "", ""), (7, "  ", "", ""), (None, base, "", ""), (3, base, "b", None), (1, "alone here", "", ""), (2, "other words entirely in this text", "", "")]
    rows += [(100 + i, base if i % 2 else f"{base} tail {i}", "", "") for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op1_simhash_pivots(spark, str(tmp_path)).collect()
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = slow_components(list(prints.items()))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted((r[0], f"{prints[r[0]]:016x}", want[r[0]]) for r in rows if r[0] is not None)
    (lost,) = [r for r in got if r.doc_id is None]
    assert lost.fingerprint == f"{slow_fingerprint(base):016x}" and lost.component_id is None and lost.n_class is None
    kept = simhash.one_of_each(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "fp", "node"]
    rows_kept = kept.collect()
    assert sorted(str(r.doc_id) for r in rows_kept) == ["1", "2", "3", "5", "None"]


def test_alike_documents(spark):
    rnd = random.Random(3)
    pool = [f"w{i}" for i in range(5000)]
    rows, group = [], {}
    for g in range(40):
        words = [rnd.choice(pool) for _ in range(rnd.choice([60, 200, 500]))]
        for k in range(rnd.choice([1, 2, 5, 30])):
            copy = list(words)
            for _ in range(len(words) // 60 if k else 0):  # leaves about 0.85 of the shingles
                copy[rnd.randrange(len(copy))] = rnd.choice(pool)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    other = [rnd.choice(pool) for _ in range(400)]
    for k in range(4):  # half the shingles shared: not alike
        group[len(rows)] = 1000 + k
        rows.append((len(rows), " ".join(other[:260] + [rnd.choice(pool) for _ in range(140)])))
    got = {r.doc_id: r.component_id for r in simhash.alike_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    first = {g: min(i for i in group if group[i] == g) for g in group.values()}
    assert all(first[group[got[i]]] == got[i] and group[got[i]] == group[i] or got[i] >= first[group[i]] and group[got[i]] == group[i] for i in group)
    right = sum(got[i] == first[group[i]] for i in group)
    assert right >= 0.97 * len(group)


def shingle_pair(rnd, tag, n, shared):
    """Two texts of n words that share their first ``shared`` words, and the likeness of their five-word shingles."""
    words = [f"{tag}{rnd.getrandbits(32):x}" for _ in range(n)]
    other = words[:shared] + [f"{tag}{rnd.getrandbits(32):x}" for _ in range(n - shared)]
    sets = [{tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, other)]
    return " ".join(words), " ".join(other), len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_isolated_pairs_of_four_in_five(spark):
    rnd = random.Random(11)
    pairs = [shingle_pair(rnd, f"p{n}x", 304, 273 + n % 7) for n in range(400)]
    assert all(0.81 < j < 0.85 for *_, j in pairs)
    rows = [(2 * n + k, pairs[n][k]) for n in range(len(pairs)) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash.alike_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    found = sum(got[2 * n + 1] == 2 * n for n in range(len(pairs)))
    assert found >= 0.99 * len(pairs)
    assert all(got[2 * n] == 2 * n and got[2 * n + 1] in (2 * n, 2 * n + 1) for n in range(len(pairs)))


def test_shingles_settle_links(spark):
    rnd = random.Random(12)
    pairs = [shingle_pair(rnd, f"r{n}x", *((301, 268) if n % 9 == 0 else (304, 256 + n % 24))) for n in range(450)]
    assert sum(abs(j - 0.8) < 1e-12 for *_, j in pairs) == 50 and min(j for *_, j in pairs) < 0.73
    rows = [(2 * n + k, pairs[n][k]) for n in range(len(pairs)) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash.alike_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    linked = [got[2 * n + 1] == 2 * n for n in range(len(pairs))]
    wrong = [j for (*_, j), x in zip(pairs, linked) if x and j < 0.8 - 1e-9]
    lost = [j for (*_, j), x in zip(pairs, linked) if not x and j >= 0.8 - 1e-9]
    assert (len(wrong), len(lost) <= 2) == (0, True), (len(wrong), len(lost), len(pairs))


def family(rnd, tag, n, words, changed):
    """Copies of one text with ``changed`` words replaced in each."""
    base = [f"{tag}{rnd.getrandbits(32):x}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for i in rnd.sample(range(words), changed):
            copy[i] = f"{tag}{rnd.getrandbits(32):x}"
        out.append(" ".join(copy))
    return out


def exact_classes(texts):
    """Components of all pairs with four in five shingles shared, by plain comparison; the smallest index names one."""
    sets = [frozenset(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for h in s:
            holders.setdefault(h, []).append(i)
    seen = set()
    for held in holders.values():
        for i in held:
            for j in held:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    shared = len(sets[i] & sets[j])
                    if 9 * shared >= 4 * (len(sets[i]) + len(sets[j])):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_families_at_the_edge(spark):
    """Texts of one template that are alike in part: 6 words of 300 changed leaves 0.67, 4 leave 0.76, 3 leave 0.82."""
    rnd = random.Random(31)
    texts = [t for n, k in ((60, 6), (60, 4), (40, 3), (40, 2)) for t in family(rnd, f"f{k}x", n, 300, k)]
    rnd.shuffle(texts)
    got = [r.component_id for r in simhash.alike_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).orderBy("doc_id").collect()]
    want = exact_classes(texts)
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(texts) and len(set(want)) > 40


def test_rows_of_one_doc_id_are_judged_by_their_texts(spark):
    rnd = random.Random(32)
    a, b, c = (family(rnd, x, 1, 80, 0)[0] for x in "abc")
    near = " ".join([*a.split()[:79], "other"])
    rows = [(1, a, "p"), (1, b, "q"), (1, b, "r"), (2, near, "s"), (2, c, "t"), (3, None, "u"), (3, "", "v"), (None, a, "w")]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, kept_id string").withColumn("row", F.lit(1)).withColumn("text_mark", F.lit(2)).withColumn("key", F.lit(3)))
    assert out.columns == ["doc_id", "text", "kept_id", "row", "text_mark", "key"]
    kept = sorted(r.kept_id for r in out.collect())
    assert [x for x in kept if x not in "qruv"] == ["p", "t", "w"] and sum(x in "qr" for x in kept) == 1 and sum(x in "uv" for x in kept) == 1


def test_one_of_each_takes_the_linked_fingerprints(spark, monkeypatch):
    """The stage drops what the fingerprints link, also pairs that shingles alone would keep, and then what shingles find."""
    rnd = random.Random(41)
    chant = "one two three four five six seven " * 200
    linked = [chant + family(rnd, x, 1, 50, 0)[0] for x in "ab"]
    assert len({simhash.fingerprint(t.encode()) for t in linked}) == 1
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in linked]
    assert len(sets[0] & sets[1]) < 0.1 * len(sets[0] | sets[1])
    rows = list(enumerate([*linked, *family(rnd, "c", 2, 300, 2), "alone"]))
    tables, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a: tables.append(sorted(r.fp for r in fps.collect())) or plain(fps, *a))
    kept = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert tables == [sorted({simhash.fingerprint(t.encode()) for _, t in rows})]
    assert kept == [0, 2, 4]


def test_recall_on_whole_documents(spark, tmp_path):
    """All pairs of the documents by an exact join on shared shingles, at likeness 0.8 and more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text").orderBy("doc_id").collect()]
    root = exact_classes([t for _, t in rows])
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(root)}
    got = {r.doc_id: r.component_id for r in simhash.alike_documents(docs).collect()}
    joined = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in joined) >= 0.99 * len(joined) > 0
    assert all(got[i] == i for i in want if want[i] == i)


def test_shingles_are_fetched_for_texts_that_face_another(spark):
    """Forty sketches share a band and little else; two of them agree in three quarters, and their shingles make them one."""
    rnd = random.Random(9)
    size = 2 * simhash.BANDS * simhash.ROWS
    sketches = [bytes(12) + rnd.randbytes(size - 12) for _ in range(39)]
    sketches.append(sketches[0][: size * 3 // 4] + rnd.randbytes(size - size * 3 // 4))
    nodes = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(sketches)], "fp bigint, sketch binary")
    fetched = []

    def sets(ends):
        fetched.extend(sorted(r.fp for r in ends.collect()))
        return ends.select("fp", F.array(*[F.lit(x).cast("bigint") for x in range(9)], F.col("fp")).alias("shingles"))

    roots = simhash._alike_roots(nodes, lambda pairs: pairs.where("false"), sets)
    got = {r.fp: r.root for r in roots.collect()}
    assert fetched == [0, 39]
    assert got[0] == got[39] and len(set(got.values())) == 39


def test_empty_table(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL("doc_id bigint, text string"))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0
