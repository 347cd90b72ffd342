"""From documents to packed training windows: each stage works on what its predecessor kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatgrid.llm import chunks, mixing, packing, quality, simhash
from heatgrid.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of alike texts, that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller doc_id holds."""
    return chunks.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the labelled domains to their target totals."""
    return mixing.mixed(docs, mixing.domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows, with their ids."""
    return packing.pack(docs, packing.vocabulary_path(), keep_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mix), ("packing", pack)]

#: Rolling hashes, iterated rates and token ids have no SQL form; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
