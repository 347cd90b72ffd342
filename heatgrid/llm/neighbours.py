"""Nearest vectors by inner product: randomly rotated one-bit codes choose the vectors that are worth an exact product."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.session import cut_lineage

NEAREST = 20
EVERY = 20  # one row in so many is a query
BLOCK, QUERY_BLOCK = 16384, 4096  # vectors of a block of candidates and of queries, on average
SLICE = 256  # queries estimated at once
CONFIDENCE = 1.9  # standard errors of an estimate that its bounds allow for, as published
FIRST = 64  # vectors of the best estimates whose exact products set the bar
PAIRS = 1 << 17  # exact products at once


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, from a fixed seed; codes are padded to whole bytes."""
    size = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(20260103).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """One row for each vec_id with a finite vector that is not zero; the smallest vector where an id is repeated."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    return rows.where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def centre(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean vector of all rows, from one sum for each partition and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total, n = total + _matrix(batch.column(0), dim).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())], names=["i", "x", "n"])

    sums = rows.select("embedding").mapInArrow(run, "i int, x double, n bigint").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return np.array([r.x for r in sums.orderBy("i").collect()])


def codes(rows: DataFrame, mean: np.ndarray) -> DataFrame:
    """(vec_id, embedding, bits, scale, error): signs of the rotated difference from the mean, packed, and corrections.

    The inner product of the difference with a query is near ``scale`` times the signs' sum over the rotated query; its
    standard error is ``error`` times the query's norm.
    """
    turn, dim = rotation(len(mean)), len(mean)
    size = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_matrix(batch.column("embedding"), dim) - mean) @ turn
            norm = np.linalg.norm(x, axis=1)
            part = np.abs(x).sum(axis=1) / np.maximum(norm, 1e-300) / sqrt(size)  # of the difference that the signs keep
            part = np.where(norm > 0, part, 1.0)
            bits = np.packbits(x > 0, axis=1)
            arrays = [batch.column("vec_id"), batch.column("embedding"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm / part / sqrt(size)), pa.array(norm * np.sqrt(np.maximum(1 - part**2, 0)) / part / sqrt(max(size - 1, 1)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "embedding", "bits", "scale", "error"])

    return rows.mapInArrow(run, "vec_id bigint, embedding array<double>, bits binary, scale double, error double")


def best(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each key's ``k`` largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, keys))
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1)) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def search_block(ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, scale: np.ndarray, error: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, mean: np.ndarray, k: int) -> list[np.ndarray]:
    """(query, candidate, score) of the nearest in one block. The best estimates are made exact first; the k-th largest
    product among them is the bar, and every other vector whose upper bound reaches it is reranked too."""
    turn = rotation(len(mean))
    signs = (np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1) * scale[:, None].astype(np.float32)
    error = (CONFIDENCE * error).astype(np.float32)[:, None]
    out = []

    def products(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        parts = ((vectors[rows[i : i + PAIRS]] * q[columns[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(rows), PAIRS))
        return np.concatenate([np.zeros(0), *parts])

    for at in range(0, len(queries), SLICE):
        q, names = queries[at : at + SLICE], query_ids[at : at + SLICE]
        upper = signs @ (q @ turn).T.astype(np.float32) + (q @ mean).astype(np.float32)
        upper[ids[:, None] == names] = -np.inf
        first = min(max(FIRST, k), len(ids))
        head = np.argpartition(upper, len(ids) - first, axis=0)[len(ids) - first :]
        exact = products(head.ravel(), np.tile(np.arange(len(q)), first)).reshape(head.shape)
        exact[ids[head] == names] = -np.inf
        bar = np.partition(exact, first - min(k, first), axis=0)[first - min(k, first)]
        upper += error * np.linalg.norm(q, axis=1).astype(np.float32)
        rows, columns = np.nonzero(upper >= bar - 1e-5 * np.abs(bar))
        other = ids[rows] != names[columns]
        rows, columns = rows[other], columns[other]
        score = products(rows, columns)
        rows, columns, score = np.append(rows, head.ravel()), np.append(columns, np.tile(np.arange(len(q)), first)), np.append(score, exact.ravel())
        seen = np.unique(rows * len(q) + columns, return_index=True)[1]
        seen = seen[score[seen] > -np.inf]
        rows, columns, score = rows[seen], columns[seen], score[seen]
        top = best(columns, ids[rows], score, k)
        out.append((names[columns[top]], ids[rows[top]], score[top]))
    return [np.concatenate(c) for c in zip(*out)]


def search(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest inner product found for each query.

    Queries are the rows whose vec_id divides by ``every``; candidates all rows but the query's own. Scores are exact, in
    double precision; ties go to the smaller vec_id; with fewer candidates all are returned. Vectors that are null, zero,
    of another length than most, or hold null or non-finite components, and rows with a null vec_id take no part; rows that repeat a
    vec_id count once. Every vector is indexed and every code is held against every query: blocks of codes meet blocks of
    queries, each pair of blocks in a task of its own, so memory is bounded by two blocks. Larger data take larger blocks.
    """
    rows = cut_lineage(usable(vectors))
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("vec_id").alias("n")).orderBy(F.desc("n"), "dim").first()
    spark = vectors.sparkSession
    schema = "query_id bigint, vec_id bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("embedding") == lengths.dim)
    mean = centre(rows, lengths.dim)
    indexed = cut_lineage(codes(rows, mean))
    asked = indexed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding")
    parts, askers = -(-lengths.n // block), max(1, -(-asked.count() // query_block))
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    left = indexed.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(askers - 1)), lambda i: i * F.lit(parts) + place(parts, 1))))
    right = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: i + place(askers, 2) * F.lit(parts))))

    def meet(key, some: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if some.num_rows and queries.num_rows:
            bits = np.frombuffer(b"".join(some["bits"].to_pylist()), dtype=np.uint8).reshape(some.num_rows, -1)
            found = search_block(some["vec_id"].to_numpy(), _matrix(some["embedding"], len(mean)), bits, some["scale"].to_numpy(), some["error"].to_numpy(), queries["vec_id"].to_numpy(), _matrix(queries["embedding"], len(mean)), mean, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    near = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_rotated_codes(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {"op5_rotated_codes": (op5_rotated_codes, None)}
