"""Resampling documents towards a target text: hashed n-grams of concatenated batches, importance weights, Gumbel top-k."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import documents
from heatgrid.session import cut_lineage, distilled

BUCKETS = 10_000
MIN_WORDS = 20  # of a document that may be drawn
PERCENT = 25  # of these that are drawn
SEED = 7
STEP = 1 << 20  # bytes of texts joined at once

#: Bytes of words once A-Z is in lower case: digits, letters and all of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SENTINEL = b"\n"  # a separator of words, so no word crosses it


def _pieces(texts: Iterator[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(row, piece) lists of about STEP bytes in all; a text that is longer by itself is cut between words."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            gap = GAP.search(text, at + STEP) if len(text) - at > STEP else None
            end = gap.start() if gap else len(text)
            held.append((row, text[at:end]))
            size += end - at
            at = end
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


def features(texts: Iterator[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, row of each feature, bucket of each feature) of joined texts, some texts at a time.

    Texts are joined with sentinels and searched once for words; the offsets of the texts tell by binary search whose a
    word is. Pairs of words of different texts are masked out. The crc32 of a pair goes on from that of its first word
    and a space. A text that comes in several pieces keeps the pair across their border.
    """
    last_row, last = -1, 0  # the last word so far, and a space, hashed
    for group in _pieces(texts):
        rows = np.fromiter((row for row, _ in group), dtype=np.int64, count=len(group))
        ends = np.cumsum([len(piece) + len(SENTINEL) for _, piece in group])
        found = list(WORD.finditer(SENTINEL.join([piece for _, piece in group]).lower()))
        if not found:
            continue
        words = [m[0] for m in found]
        owner = rows[np.searchsorted(ends, np.fromiter((m.start() for m in found), dtype=np.int64, count=len(found)), side="right")]
        single = list(map(zlib.crc32, words))
        spaced = [zlib.crc32(b" ", c) for c in single]
        pairs = np.fromiter(map(zlib.crc32, words, [last, *spaced]), dtype=np.int64, count=len(words))
        same = owner == np.append(last_row, owner[:-1])
        yield owner, np.concatenate([owner, owner[same]]), np.concatenate([np.array(single, dtype=np.int64), pairs[same]]) % buckets
        last_row, last = owner[-1], spaced[-1]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text"))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, counted inside the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, hits in features(_texts(batch), buckets):
                total += np.bincount(hits, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of each bucket's share in ``target`` and in ``docs``, smoothed by one, rounded down.

    One number for each bucket comes to the driver, whatever the size of the tables.
    """
    dense = lambda df: dict(bucket_counts(df, buckets).collect())
    raw, aim = dense(docs), dense(target)
    s, t = sum(raw.values()), sum(aim.values())
    return [math.floor(1000 * math.log((aim.get(b, 0) + 1) * (s + buckets) / ((raw.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the mean gain of the text's features, rounded down; 0 without any."""
    table = np.array(gain, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, counts, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for owner, rows, hits in features(_texts(batch), len(table)):
                words += np.bincount(owner, minlength=n)
                counts += np.bincount(rows, minlength=n)
                total += np.bincount(rows, weights=table[hits], minlength=n).astype(np.int64)
            mean = np.where(counts > 0, total // np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(counts), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate of the id and the seed, rounded down; a null id is hashed as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def with_ranks(rows: DataFrame, draw: int) -> DataFrame:
    """``rows`` (doc_id, score, any others; written) with rank 1, 2, ... of the ``draw`` highest scores, then null.

    Ties go to the smaller doc_id, a null one last. Rows are sorted by ranges of (score, doc_id); a range's first rank is
    the number of rows in the ranges before it, one number for each partition. Rows that repeat each other are one row
    with a count until they have their ranks, so no range is larger for them.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    once = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    dealt = cut_lineage(once.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("copies").alias("n")).collect())
    before, at = {}, 0
    for part, n in sizes:
        before[part], at = at, at + n
    starts = rows.sparkSession.createDataFrame([*before.items()], T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())]))
    line = Window.partitionBy("part").orderBy(*order, *[c for c in rows.columns if c not in ("score", "doc_id")]).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("copies").over(line), F.lit(0)) + 1
    ranked = dealt.join(F.broadcast(starts), "part").withColumn("first", first)
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    return ranked.select(*rows.columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text, any others, not read).

    Of the N rows with ``min_words`` words and more, floor(percent * N / 100) with the highest scores are drawn: they have
    a rank, the others null. Null and empty texts have no features, weight 0 and are not drawn; repeated rows stay
    repeated and each may be drawn; with an empty ``target`` the gains compare with even shares. The texts are read twice,
    for the counts and for the weights, and only buckets, sums and ids leave a task.
    """
    scored = weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = cut_lineage(scored)
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return with_ranks(scored.where(able), percent * n // 100).unionByName(rest)


def op13_batched_importance(spark: SparkSession, sf: str) -> DataFrame:
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    return distilled(spark, lambda: resampled(documents(spark, sf), target)).drop("n_words")


QUERIES = {"op13_batched_importance": (op13_batched_importance, None)}
