"""Union and reshape operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name; absent columns become NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def pivot_long(df: DataFrame, key: str, column: str, values: Sequence, value: str) -> DataFrame:
    """Wide form over a known list of column values."""
    return df.groupBy(key).pivot(column, list(values)).agg(F.first(value))


def unpivot_wide(df: DataFrame, key: str, columns: Sequence[str], column: str, value: str) -> DataFrame:
    """Long form of a wide frame; missing entries are left out."""
    return df.unpivot([key], list(columns), column, value).where(F.col(value).isNotNull())
