"""Digest index: against a plain dictionary, over batches and sessions, odd input, the kind of join."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm import exact
from heatgrid.session import cut_lineage

ROWS = "doc_id bigint, text string"


def slow(rows):
    """(doc_id, keep_id, group_size, kept, digest) of every row, sorted; None ids name nothing."""
    mark = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = Counter(mark(t) for _, t in rows)
    keep = {}
    for i, t in rows:
        if i is not None:
            keep[mark(t)] = max(i, keep.get(mark(t), i))
    out = [(i, keep.get(mark(t)), size[mark(t)], None if i is None or mark(t) not in keep else i == keep[mark(t)], mark(t)) for i, t in rows]
    return sorted(out, key=str)


def got_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_query_against_a_dictionary(spark, tmp_path):
    rnd = random.Random(5)
    texts = [f"text {n} ß日" for n in range(60)] + ["", " ", "A", "a", "x" * 3_000_000]
    rows = [(i, rnd.choice(texts)) for i in range(400)] + [(1000 + i, "the same third") for i in range(300)]
    rows += [(3, None), (7, "twice"), (7, "twice"), (None, "twice"), (None, "no id at all"), (None, None)]
    df = spark.createDataFrame(rows, ROWS).withColumn("digest", F.lit("x")).withColumn("keep_id", F.lit(1)).withColumn("kept", F.lit(2))
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got_of(exact.op11_digest_index(spark, str(tmp_path))) == slow(rows)


def test_index_grows_and_outlives_its_table(spark, tmp_path):
    path = f"{tmp_path}/index"
    day = lambda *rows: spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, row string")
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in df.collect())
    first = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c")]
    assert ids(exact.admitted(day(*first), path, 5)) == [(False, 0, "c"), (True, 2, "a"), (True, 3, "b")]
    spark.sql(f"DROP TABLE {exact.open_index(spark, path)}")  # a later session knows only the folder
    second = day((9, "a"), (4, "c"), (8, "c"), (5, ""), (6, None))
    out = exact.admitted(second, path, 99)
    assert out.columns == ["doc_id", "text", "row"]
    assert ids(out) == [(True, 6, None), (True, 8, "c")]
    assert ids(exact.admitted(second, path)) == ids(out)  # the same batch again, as after a failure
    table = exact.open_index(spark, path)
    assert sorted(r.keep_id for r in spark.table(table).collect()) == [2, 3, 6, 8]
    assert spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"] == "5"


def test_one_doc_id_with_two_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], ROWS)
    assert sorted(r.text for r in exact.admitted(docs, f"{tmp_path}/index", 3).collect()) == ["a", "b"]


def test_normal_form(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], ROWS)
    kept = exact.admitted(docs, f"{tmp_path}/index", 3, lambda text: F.lower(F.regexp_replace(text, " +", " ")))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_index_is_joined_by_bucket_without_a_shuffle_of_its_own(spark, tmp_path):
    table = exact.open_index(spark, f"{tmp_path}/index", 6)
    rows = cut_lineage(exact.digests(spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))))
    exact.add(rows, table)
    fresh = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    joined = fresh.join(spark.table(table).select("digest").hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert joined.count() == 0


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], T.StructType.fromDDL(ROWS))
    assert exact.admitted(empty, f"{tmp_path}/index", 3).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert exact.op11_digest_index(spark, str(tmp_path)).count() == 0
