"""The pipeline, stage by stage, on a small corpus with planted copies, junk and passages."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from zlib import crc32

import corpus_pipeline
from test_packing import slow_ids
from test_quality import slow_counts

import __spark_entry__ as entry

RND = random.Random(21)
POOL = ["".join(RND.choice("abcdeghilmnorstuéñ") for _ in range(RND.randrange(2, 9))) for _ in range(4000)]


def prose(n):
    return " ".join(RND.choice(POOL) for _ in range(n))


def corpus():
    rows = [(i, prose(RND.randrange(60, 300)), "en", f"s{i % 5}") for i in range(120)]
    passage = prose(70)
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(10)]  # copies
    rows += [(300 + i, f"{rows[20 + i][1]} tail{i}", "en", "s2") for i in range(10)]  # near copies
    rows += [(400 + i, f"{prose(120)} {passage} {prose(90)}", "en", "s3") for i in range(6)]
    rows += [(500, "too short", "en", "s4"), (501, "again " * 80, "en", "s4"), (502, None, None, None), (503, "", "en", "s4")]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 3 > 0), int(r[0] % 10 == 0)) for r in rows if r[0] % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert docs.columns == columns or name == "packing"
        out.append(docs.collect())
    text = {r[0]: r[1] for r in rows}
    good = {i for i, t in text.items() if slow_counts(t)[0] >= 10 and 100 * slow_counts(t)[4] <= 20 * slow_counts(t)[0]}
    assert {r.doc_id for r in out[1]} == good and not {500, 501, 502, 503} & good
    assert {r.doc_id for r in out[2]} == {i for i in good if not 200 <= i < 400}
    cut = {r.doc_id for r in out[3] if r.text != text[r.doc_id]}
    assert cut == set(range(401, 406)) and {r.doc_id for r in out[3]} == {r.doc_id for r in out[2]}
    assert all(r.n_chars == len(r.text) for r in out[3])
    before = {r.doc_id: r.text for r in out[3]}
    assert out[4] and all(before[r.doc_id] == r.text for r in out[4])
    drawn, pieces = Counter(r.doc_id for r in out[4]), defaultdict(list)
    for r in out[5]:
        assert crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(drawn)
    for i, found in pieces.items():
        if drawn[i] == 1:
            ids = b"".join(bytes(r.ids) for r in sorted(found, key=lambda r: r.start))
            assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == slow_ids(before[i])


def test_registered(spark, tmp_path):
    rows = corpus()[:40]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = entry.queries()["pipeline"](spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").collect()} <= {r[0] for r in rows}
    assert sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()) == 13
