"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.session import cut_lineage

#: Separators of words: space and the five control characters 0x09 to 0x0D.
GAPS = "[\\x20\\x09-\\x0D]+"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def text_crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def folded(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text with A-Z in lower case and one space between words, and where each word starts and ends."""
    raw = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    solid = raw != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    kept = raw[keep]
    if len(kept) and kept[0] == 32:
        kept = kept[1:]
    if len(kept) and kept[-1] == 32:
        kept = kept[:-1]
    if not len(kept):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(np.flatnonzero(kept == 32), len(kept))
    return kept.tobytes(), np.append(0, ends[:-1] + 1), ends


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (keys, n, any others; one row a key, written), hot keys dealt over all partitions.

    n tells how many rows a key has. A key with a share of 1 / partitions of them or more is hot; there are at most as
    many hot keys as partitions, so these are broadcast to the rows, whose other columns then choose the partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * parts >= total
    marks = F.broadcast(groups.where(hot).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(parts)).cast("int")).otherwise(0)
    salted = groups.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return rows.join(marks, keys, "left").withColumn("_salt", salt).drop("_hot").join(salted, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (u, v), both bigint, as (node, root): root is the smallest node reachable.

    Alternating star contraction: neighbours are hung under the smallest neighbour, first the larger ones of every node,
    then the smaller ones, until nothing changes. Minima are summed before they are shuffled and written before they are
    joined, so that a node with very many neighbours is only a skewed join between two tables, which Spark splits.
    Loops and repeated edges do no harm; nodes without an edge to another node are not in the result.
    """
    ends = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = lambda df: tuple(df.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = cut_lineage(ends(edges))
    seen, state = None, mark(now)
    while state != seen and state[0]:
        low = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = cut_lineage(low.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        now = cut_lineage(ends(now.join(low, now.v == low.x).select("u", F.col("m").alias("v"))))
        low = cut_lineage(now.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")))
        down = now.join(low, now.u == low.x).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut_lineage(ends(down.select("e.u", "e.v")))
        seen, state = state, mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
