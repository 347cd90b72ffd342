"""Hourly feed to daily records as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heatgrid.operators.daily import DAILY_INDICES, daily_aggregates, degree_hours, exceedance_counts, hourly_indices
from heatgrid.params import NIGHT_END_HOUR, NIGHT_START_HOUR, WBGT_HOUR_THRESHOLDS
from heatgrid.session import scratch_path
from heatgrid.sources.weather import NWP_SCHEMA, nwp_rows

LATENESS = "6 hours"


def event_time(hourly: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Watermarked local time; watermarks need a zoned timestamp."""
    return hourly.withColumn("_at", F.col("ts_ist").cast("timestamp")).withWatermark("_at", lateness)


def stream_daily(hourly: DataFrame, indices: Sequence[str] = DAILY_INDICES, lateness: str = LATENESS) -> DataFrame:
    """Daily statistics per cell, emitted once the day is complete."""
    day = F.window("_at", "1 day")
    rows = event_time(hourly, lateness).groupBy("cell_id", day).agg(
        *daily_aggregates(indices),
        degree_hours("wbgt").alias("wbgt_degree_hours"),
        *exceedance_counts("wbgt", WBGT_HOUR_THRESHOLDS, "wbgt_hours_above_"),
    )
    return rows.withColumn("date", F.to_date("window.start")).drop("window")


def stream_nights(hourly: DataFrame, cols: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """Night minima per cell; the night window opens at 22:00 and belongs to the next date."""
    hour = F.hour("_at")
    night = event_time(hourly, lateness).where((hour >= NIGHT_START_HOUR) | (hour < NIGHT_END_HOUR))
    window = F.window("_at", "1 day", startTime=f"{NIGHT_START_HOUR} hours")
    rows = night.groupBy("cell_id", window).agg(*[F.min(c).alias(f"{c}_night_min") for c in cols])
    return rows.withColumn("date", F.to_date("window.end")).drop("window")


def live_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Landed forecast responses as a stream of hourly indices.

    The same projection serves the batch build, so both agree by construction.
    """
    return hourly_indices(nwp_rows(spark.readStream.schema(NWP_SCHEMA).json(path)))


def late_rows(query: StreamingQuery, seen: dict[int, int]) -> None:
    """Adds to ``seen``, by batch, the rows left out because the watermark had passed them.

    A query remembers its last batches only, so this is asked again and again
    while it runs.
    """
    for progress in query.recentProgress:
        p = json.loads(progress.json)
        seen[p["batchId"]] = max(seen.get(p["batchId"], 0), sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for as long as a query starts and runs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def run_to_table(stream: DataFrame, name: str, stats: dict | None = None, places: tuple[str, str] | None = None) -> DataFrame:
    """Process everything available into a table in the shared folder and read it back.

    ``stats`` receives the number of late rows. ``places``, the table's folder and
    that of the state, lets a later call go on where this one ended.
    """
    spark = stream.sparkSession
    out, state = places or (scratch_path(spark, name), scratch_path(spark, f"{name}-state"))
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    seen: dict[int, int] = {}
    while not query.awaitTermination(1):
        late_rows(query, seen)
    late_rows(query, seen)
    if stats is not None:
        stats["late_rows"] = sum(seen.values())
    return spark.read.schema(stream.schema).parquet(out)
