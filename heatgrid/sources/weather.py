"""Weather sources and the partitioned hourly panel."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from heatgrid.functions import calendar
from heatgrid.params import VALUE_COLUMNS
from heatgrid.session import scratch_path

#: ``{lat}_{lon}_{year}.csv``: fixed pattern.
FILE_GLOB = "*_*_[0-9][0-9][0-9][0-9].csv"
FILE_PATTERN = r"^(-?\d+(?:\.\d+)?)_(-?\d+(?:\.\d+)?)_(\d{4})\.csv$"
#: Characters that Spark does not put in the name of a folder.
UNSAFE = re.compile("[\\x01-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]")

NWP_SCHEMA = (
    "cell_id int, lat double, lon double, hourly struct<time: array<string>, temperature_2m: array<double>, "
    "dew_point_2m: array<double>, surface_pressure: array<double>, wind_speed_10m: array<double>, "
    "shortwave_radiation: array<double>>"
)
#: Response field -> panel column, in the response's units: fixed values.
NWP_FIELDS = {
    "temperature_2m": "T2M",
    "dew_point_2m": "T2MDEW",
    "surface_pressure": "PS",
    "wind_speed_10m": "WS10M",
    "shortwave_radiation": "ALLSKY_SFC_SW_DWN",
}


def file_parts(name: Column) -> dict[str, Column]:
    """lat, lon and year of a file name; NULL when it does not match."""
    parts = [F.nullif(F.regexp_extract(name, FILE_PATTERN, i), F.lit("")) for i in (1, 2, 3)]
    return {"lat": parts[0].cast("double"), "lon": parts[1].cast("double"), "year": parts[2].cast("int")}


def _a_file(spark: SparkSession, path: str) -> str | None:
    """A matching file of a folder: its header is read without the listing of all others that a scan begins with."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/[!_.]{FILE_GLOB}")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return found[0].getPath().toString() if found else None


def read_hourly_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All matching hourly files below a folder as one scan.

    The first, unnamed column is the hour stamp. The header must hold every
    value column, and with ``strict`` every file must have the same header.
    Files whose name does not match are left out.
    """
    reader = lambda: spark.read.option("header", True).option("pathGlobFilter", FILE_GLOB)
    try:
        one = _a_file(spark, path)
        names = (one and reader().csv(one).columns) or reader().option("inferSchema", False).csv(path).columns
    except AnalysisException as e:
        raise RuntimeError("no hourly files match {lat}_{lon}_{year}.csv") from e
    missing = [c for c in VALUE_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"missing expected column(s) {missing}")
    # The stamp column has an empty header; the rest is laid down in file order,
    # so Spark checks every file's header against this schema.
    schema = StructType([StructField("", StringType()), *[StructField(c, DoubleType()) for c in names[1:]]])
    scanned = reader().option("enforceSchema", not strict).option("mode", "FAILFAST").schema(schema).csv(path)
    named = scanned.withColumn("file", F.col("_metadata.file_name")).toDF("stamp", *names[1:], "file")
    return named.select("stamp", *VALUE_COLUMNS, "file").withColumns(file_parts(F.col("file"))).where(F.col("year").isNotNull())


def _file_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes rows (file, line), those of a file one after another, as files of ``folder``; a file shows when it is whole."""
    header = ",".join(["", *VALUE_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, files = None, None, 0
        own = uuid.uuid4().hex
        goal = lambda: f"{folder}/{UNSAFE.sub(lambda c: f'%{ord(c[0]):02X}', name)}"
        held = f"{folder}/.{own}"
        try:
            for batch in batches:
                rows = zip(batch.column("file").to_pylist(), batch.column("line").to_pylist())
                for file, lines in groupby(rows, itemgetter(0)):
                    if file != name:
                        if out:
                            out.close()
                            os.replace(held, goal())
                        name, out, files = file, open(held, "w", encoding="utf-8", newline=""), files + 1
                        out.write(f"{header}\n")
                    out.writelines(f"{line}\n" for _, line in lines)
            if out:
                out.close()
                os.replace(held, goal())
        finally:
            if os.path.exists(held):
                os.remove(held)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return run


def write_cell_years(hours: DataFrame, path: str) -> None:
    """Hourly rows (lat, lon, year, stamp and the value columns) as one file for each cell and year, named by them.

    Rows are placed by file and sorted; in a folder that tasks can open, a task
    writes its files under their own names. Elsewhere Spark's writer does, which
    names files itself, so each lies in a folder of the wanted name first and is
    moved in the folder's place at the end. A file holds a cell's hours of one
    year, which bounds it.
    """
    spark = hours.sparkSession
    name = F.concat_ws("_", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("year").cast("string"))
    rows = hours.select(F.concat(name, F.lit(".csv")).alias("file"), "stamp", *VALUE_COLUMNS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = rows.repartition(parts, "file").sortWithinPartitions("file", "stamp")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    goal = jvm.org.apache.hadoop.fs.Path(path)
    fs = goal.getFileSystem(conf)
    fs.mkdirs(goal)
    if fs.getUri().getScheme() == "file":
        lines = placed.select("file", F.to_csv(F.struct("stamp", *VALUE_COLUMNS), {"emptyValue": ""}).alias("line"))
        lines.mapInArrow(_file_writer(fs.makeQualified(goal).toUri().getPath()), "files bigint").agg(F.sum("files")).collect()
        return
    staged = scratch_path(spark, "cell-years")
    placed.toDF("file", "", *VALUE_COLUMNS).write.partitionBy("file").option("header", True).option("emptyValue", "").csv(staged)
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/file=*/part-*.csv")):
        fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(goal, part.getPath().getParent().getName().removeprefix("file=")))


def inventory(raw: DataFrame) -> DataFrame:
    """Distinct (lat, lon, year) on disk; stops when there is none."""
    found = raw.select("lat", "lon", "year").distinct()
    if found.isEmpty():
        raise RuntimeError("no hourly files match {lat}_{lon}_{year}.csv")
    return found


def write_panel(panel: DataFrame, path: str, keys: Sequence[str] = ("cell_id", "ts_utc"), force: bool = False) -> list[int]:
    """Year-partitioned panel, sorted within files; cell-years already there are kept, new ones are added.

    Rows are spread over (year, cell) so that no year is written by one task.
    With ``force`` the years that receive rows are replaced. Returns the years
    that were there before.
    """
    spark = panel.sparkSession
    have = set() if force else existing_years(spark, path)
    if have:
        panel = panel.join(spark.read.parquet(path).select("year", "cell_id").distinct(), ["year", "cell_id"], "left_anti").select(*panel.columns)
    rows = panel.repartition("year", "cell_id").sortWithinPartitions("year", *keys).write.option("compression", "zstd").partitionBy("year")
    if have:
        rows.mode("append").parquet(path)
    else:
        rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return sorted(have)


def existing_years(spark: SparkSession, path: str) -> set[int]:
    """Years with a partition below the panel's folder (one row per year)."""
    try:
        years = spark.read.parquet(path).select("year").distinct()
    except Exception as e:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return set()
    return {r.year for r in years.toLocalIterator()}


def load_hourly(spark: SparkSession, path: str, years: Sequence[int] = (), columns: Sequence[str] = ()) -> DataFrame:
    """Read the panel back with partition and column pruning."""
    df = spark.read.parquet(path)
    if years:
        df = df.where(F.col("year").isin(list(years)))
    return df.select(*columns) if columns else df


def write_sorted(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """Range-partitioned, sorted table."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with header and a fixed column order."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def nwp_rows(responses: DataFrame) -> DataFrame:
    """Forecast responses (parallel hourly arrays) to panel rows.

    Stamps mark the end of an hour in the source and its start here; pressure
    comes in hPa. Incomplete rows leave. Works on a batch or a stream.
    """
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.{f}").alias(c) for f, c in NWP_FIELDS.items()])
    rows = responses.select("cell_id", "lat", "lon", F.explode(zipped).alias("h")).select("cell_id", "lat", "lon", "h.*")
    start = F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")) - F.expr("INTERVAL 1 HOUR")
    timed = rows.withColumn("ts_utc", start).withColumns(
        {"ts_ist": calendar.utc_to_ist("ts_utc"), "PS": F.col("PS") / F.lit(10.0)}
    )
    return timed.select("cell_id", "lat", "lon", "ts_utc", "ts_ist", *NWP_FIELDS.values()).dropna()


def read_nwp(spark: SparkSession, path: str) -> DataFrame:
    return nwp_rows(spark.read.schema(NWP_SCHEMA).json(path))
