"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a fixed number of places, without negative zeros."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in doubles}) if doubles else df


def with_ctes(body: str, *ctes: str, recursive: bool = False) -> str:
    """SQL text from named parts and a final select."""
    seen: list[str] = []
    for c in ctes:
        if c not in seen:
            seen.append(c)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(seen) + "\n" + body.lstrip("\n")


def pick(keys: Sequence[str], doubles: Sequence[str], source: str, tail: str = "", digits: int = 4) -> str:
    """SELECT with every double rounded the way :func:`rounded` does."""
    cols = [*keys, *[f"round({c.split(' AS ')[0]}, {digits}) + 0.0e0 AS {c.split(' AS ')[-1]}" for c in doubles]]
    return f"SELECT {', '.join(cols)} FROM {source} {tail}".strip()
