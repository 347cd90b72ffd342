"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "heatgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE and skew-join handling on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster sets it to storage every executor can reach. Only where it is
    unset (local tests) is a folder of our own made and recorded.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        path = tempfile.mkdtemp(prefix="heatgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def run_root(spark: SparkSession) -> str:
    """The folder of this application below the shared one; everything a job leaves is in it."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


_open: list[str] = []  # folders of the steps under way, see distilled()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of this application, or of the step under way."""
    return "/".join([run_root(spark), *_open, f"{name}-{uuid.uuid4().hex}"])


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's folder, at the end of a job whose results are written elsewhere."""
    _remove(spark, run_root(spark))


def distilled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; the stages that it wrote on the way are removed."""
    _open.append(f"step-{uuid.uuid4().hex}")
    try:
        df, folder = make(), "/".join([run_root(spark), *_open])
    finally:
        _open.pop()
    out = cut_lineage(df)
    _remove(spark, folder)
    return out


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end, for steps whose result lies elsewhere. Such steps follow one another."""
    _open.append(f"step-{uuid.uuid4().hex}")
    folder = "/".join([run_root(spark), *_open])
    try:
        yield
    finally:
        _open.pop()
        _remove(spark, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and read it back.

    Used between rounds of iterative jobs; survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
