"""Shards as leaves of a k-d tree over document metadata, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.llm.common import documents, text_crc
from heatgrid.session import cut_lineage

SHARDS = 8


def code(name: Column) -> Column:
    """A label's place on an axis from 0 to 2^32 - 1; 0 for null."""
    return F.coalesce(F.crc32(F.encode(name.cast("string"), "UTF-8")), F.lit(0)).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """Metadata of every row: doc_id, size (UTF-8 bytes and 1), text_crc32, and the axes of the tree."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        text_crc(F.col("text")).alias("text_crc32"),
        *[c.alias(f"axis{i}") for i, c in enumerate([(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint"), code(F.col("source")), code(F.col("lang"))])],
    )


AXES = ["axis0", "axis1", "axis2"]


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in the order of the columns, written once, with ``part``, the number of a range of that order."""
    return cut_lineage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[str], weights: dict[str, Column]) -> DataFrame:
    """``rows`` of :func:`dealt` with exclusive running sums of the weights within ``keys``, which lead its order.

    A running sum is that of the row's range plus what its keys hold in earlier ranges: no task sees more than a range,
    and the sums over ranges have one row for each range and key.
    """
    inner = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = rows.groupBy(*keys, "part").agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    bases = cut_lineage(sums.select(*keys, "part", *[F.coalesce(F.sum(n).over(outer), zero).alias(f"base_{n}") for n in weights]))
    out = rows.select("*", *[F.coalesce(F.sum(w).over(inner), zero).alias(n) for n, w in weights.items()])
    out = out.join(bases, [*keys, "part"])
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"base_{n}")).alias(n) for n in weights])


def goes_right(half: Column) -> Column:
    """Whether the middle of a row's bytes lies behind ``half`` of the node's ``left`` leaves.

    In twice the bytes, to stay with whole numbers, and in decimals: bytes times leaves outgrow 64 bits.
    """
    wide = lambda c: c.cast("decimal(22,0)")
    few = lambda c: c.cast("decimal(14,0)")
    return wide(2 * F.col("before") + F.col("size")) * few(F.col("left")) > wide(2 * F.col("bytes")) * few(half)


def leaves(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``rows`` of :func:`measured` with ``node``, the leaf from 0 on.

    A node of k leaves is split at the weighted quantile k // 2 of k, the median where k is even, of the axis whose values
    in it spread widest against all documents' spread. Rows before the quantile go left; ties on the axis are ordered by
    checksum and doc_id, so equal values may be split and sizes of leaves differ by a document. ``target_bytes`` gives
    the number of leaves by the total size. Each level deals small metadata rows out once.
    """
    total = rows.agg(F.sum("size").alias("bytes"), *[F.min(a).alias(f"lo_{a}") for a in AXES], *[F.max(a).alias(f"hi_{a}") for a in AXES]).first()
    if total.bytes is None:
        return rows.withColumn("node", F.lit(0))
    k = shards or max(1, -(-total.bytes // target_bytes))
    now = rows.withColumns({"node": F.lit(0), "left": F.lit(k)})  # a node is named by its first leaf, and has ``left`` leaves
    while k > 1:
        spread = [((F.max(a) - F.min(a)).cast("double") / max(1, total[f"hi_{a}"] - total[f"lo_{a}"])) for a in AXES]
        nodes = now.groupBy("node").agg(F.sum("size").alias("bytes"), F.array(*spread).alias("spread"))
        nodes = cut_lineage(nodes.select("node", "bytes", F.array_position("spread", F.array_max("spread")).cast("int").alias("axis")))
        placed = now.join(nodes, "node").withColumn("at", F.element_at(F.array(*AXES), F.col("axis")))
        order = ["at", "text_crc32", "doc_id"]
        placed = running(dealt(placed, "node", *order), ["node"], order, {"before": F.col("size")})
        half = F.floor(F.col("left") / 2).cast("int")
        right = goes_right(half)
        split = placed.select(*rows.columns, (F.col("node") + F.when((F.col("left") > 1) & right, half).otherwise(0)).alias("node"), F.when(F.col("left") <= 1, F.col("left")).when(right, F.col("left") - half).otherwise(half).alias("left"))
        now, k = cut_lineage(split), -(-k // 2)
    return now.drop("left")


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text, lang, source, any others).

    Law ``bytes``: shards differ in size by about the largest document. slot numbers a shard's rows from 0 by doc_id,
    checksum. Null texts have size 1; null labels lie at 0 of their axis; rows with a null doc_id come first and are
    dealt like others. Repeated rows and copies are rows of their own and may lie in different shards.
    """
    order = ["doc_id", "text_crc32", "size"]
    rows = leaves(cut_lineage(measured(docs)), shards, target_bytes)
    out = running(dealt(rows, "node", *order), ["node"], order, {"slot": F.lit(1).cast("bigint")})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_kd_tree(spark: SparkSession, sf: str) -> DataFrame:
    return shard(documents(spark, sf))


QUERIES = {"op4_kd_tree": (op4_kd_tree, None)}
