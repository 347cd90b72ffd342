"""Exact duplicates against a persistent index of digests, bucketed and sorted by digest."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import documents
from heatgrid.session import cut_lineage, scratch_path

ENTRY = "digest BINARY, keep_id BIGINT"


def _folders(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """Name of the table over the index in the folder ``path``, which is made if it is not there.

    The index outlives the session: its number of buckets is part of the folder's layout, and a later session that opens
    the folder finds it again. A new index has ``buckets`` buckets, by default as many as a shuffle has partitions, so
    that a join shuffles the new side alone. An index that is there keeps its own number.
    """
    held = [int(m[1]) for m in (re.fullmatch(r"buckets-(\d+)", name) for name in _folders(spark, path)) if m]
    n = held[0] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path}/buckets-{n}'")
    return table


def digests(docs: DataFrame, normal: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """(doc_id, digest): SHA-256 of every row's text in UTF-8 after ``normal``; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.coalesce(normal(F.col("text")), F.lit("")), 256)).alias("digest"))


def add(rows: DataFrame, table: str) -> None:
    """Append the digests of ``rows`` (doc_id, digest) that the index does not hold, each with the largest doc_id that has it.

    Rows are reduced to one for each digest inside the partitions first, so a text that a third of all rows share is one
    row of each. The new digests meet the index in a sort-merge anti-join, in which the index is read by bucket and not
    shuffled. They are written before they are appended, one file for each bucket: a failed task leaves nothing behind,
    and adding the same rows again appends nothing. Rows with a null doc_id are left out.
    """
    spark = rows.sparkSession
    groups = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    fresh = cut_lineage(groups.join(spark.table(table).select("digest").hint("merge"), "digest", "left_anti"))
    n = int(spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])
    fresh.select("digest", "keep_id").repartition(n, "digest").write.insertInto(table)


def verdicts(rows: DataFrame, table: str) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every one of ``rows`` (doc_id, digest), which should lie written.

    keep_id: the holder of the text by the index; group_size: rows with that text among ``rows``; kept: whether the row is
    the holder. Rows that repeat doc_id and text share a verdict. Rows with a null doc_id count in group_size; their kept
    is null, and so is keep_id if no row with an id has the text.

    Texts with a share of 1 / partitions of all rows or more are at most as many as a shuffle has partitions: these are
    broadcast. Every other group is a small part of one shuffled partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = cut_lineage(groups.join(spark.table(table).hint("merge"), "digest", "left"))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * parts >= total
    big = F.broadcast(groups.where(hot).select(F.col("digest").alias("big_digest"), F.col("keep_id").alias("big_id"), F.col("group_size").alias("big_size")))
    marked = rows.join(big, rows.digest == big.big_digest, "left")
    rest = marked.where("big_digest IS NULL").select("doc_id", "digest").join(groups.where(~hot), "digest")
    found = marked.where("big_digest IS NOT NULL").select("doc_id", "digest", F.col("big_id").alias("keep_id"), F.col("big_size").alias("group_size"))
    return found.unionByName(rest).withColumn("kept", F.col("doc_id") == F.col("keep_id"))


def admitted(docs: DataFrame, path: str, buckets: int | None = None, normal: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) whose texts are new to the index in ``path``, once for each text.

    Of equal new texts the row of the largest doc_id stays, once if it is repeated; a text that the index holds under this
    very doc_id stays as well, so that a run that is repeated after a failure gives the same rows. Rows with a null doc_id
    stay as they are. All columns are kept, whatever their names.
    """
    spark, table = docs.sparkSession, open_index(docs.sparkSession, path, buckets)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    named = rows.where("doc_id IS NOT NULL")
    marked = cut_lineage(digests(named, normal))
    add(marked, table)
    stay = marked.distinct().join(spark.table(table).hint("merge"), "digest").where("doc_id = keep_id").select("digest", "keep_id")
    texts = named.select("row", *[c.alias(n) for c, n in zip((F.col("doc_id"), F.unhex(F.sha2(F.coalesce(normal(F.col("text")), F.lit("")), 256))), ("id", "mark"))])
    kept = texts.join(stay, (F.col("mark") == F.col("digest")) & (F.col("id") == F.col("keep_id")), "left_semi").dropDuplicates(["id", "mark"])
    return kept.select("row.*").unionByName(rows.where("doc_id IS NULL").select("row.*"))


def op11_digest_index(spark: SparkSession, sf: str) -> DataFrame:
    """The documents join a new index in two batches, those with the larger ids first, so that the largest id holds a text."""
    rows = cut_lineage(digests(documents(spark, sf)))
    table = open_index(spark, scratch_path(spark, "index"))
    middle = rows.agg(((F.min("doc_id") + F.max("doc_id")) / 2).cast("bigint")).first()[0]
    for batch in (F.col("doc_id") > F.lit(middle), F.col("doc_id") <= F.lit(middle)):
        add(rows.where(batch), table)
    return verdicts(rows, table).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op11_digest_index": (op11_digest_index, OP11_SQL)}
