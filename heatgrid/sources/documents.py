"""Nested exports and append-only logs."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def r(c: str, digits: int) -> Column:
    """Presentation rounding; missing stays missing."""
    return F.round(F.col(c), digits)


def district_documents(star: DataFrame) -> DataFrame:
    """One nested document per district."""
    return star.select(
        F.col("ahs_code").alias("id"),
        F.initcap("district").alias("name"),
        "hq",
        F.col("hq_lat").alias("lat"),
        F.col("hq_lon").alias("lon"),
        F.col("census_2011_code").alias("census2011Code"),
        F.col("pop_now").alias("population"),
        F.col("area_km2").alias("areaKm2"),
        F.struct(
            r("vuln_score", 3).alias("score"), F.col("vuln_rank").alias("rank"), F.col("vuln_tier").alias("tier"),
            r("vuln_mult", 3).alias("multiplier"), r("pillar_exposure", 3).alias("exposure"),
            r("pillar_sensitivity", 3).alias("sensitivity"), r("pillar_adaptive", 3).alias("adaptive"),
        ).alias("vulnerability"),
        F.struct(
            r("elderly_pct", 1).alias("elderlyPct"), r("children_pct", 1).alias("childrenPct"),
            r("electricity_pct", 1).alias("electricityPct"), r("clean_fuel_pct", 1).alias("cleanFuelPct"),
            r("health_insurance_pct", 1).alias("healthInsurancePct"), r("women_literate_pct", 1).alias("womenLiteratePct"),
            r("women_high_bp_pct", 1).alias("womenHighBpPct"), r("men_high_bp_pct", 1).alias("menHighBpPct"),
            r("women_anaemic_pct", 1).alias("womenAnaemicPct"), r("healthcare_travel_min", 0).alias("healthcareTravelMin"),
        ).alias("profile"),
        F.struct(
            r("cdr_now", 2).alias("cdrNow"), r("rel_rate", 3).alias("relRate"), r("deaths_share_65plus", 3).alias("deathsShare65plus")
        ).alias("mortality"),
    )


def payload_documents(place_days: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One document per (issue date, place) with its days nested by lead."""
    cols = columns or [c for c in place_days.columns if c not in ("as_of", "scope", "place_id", "lead")]
    day = F.struct("lead", *cols)
    return place_days.groupBy("as_of", "scope", "place_id").agg(F.array_sort(F.collect_list(day)).alias("days"))


def write_payloads(place_days: DataFrame, path: str) -> None:
    """JSON lines, one folder per issue date; only the dates written are replaced."""
    docs = payload_documents(place_days)
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append records (deliveries, acknowledgements, audit) to a log table."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """The newest ``limit`` records, newest first."""
    log = spark.read.parquet(path)
    return log.orderBy(F.col("at").desc(), F.col("id").desc()).limit(limit)


MANIFEST = "name string, rows long, checksum long, schema string"


def _marks(df: DataFrame) -> DataFrame:
    """(rows, checksum) of a table, whatever the order of its rows."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum"))


def write_bundle(tables: dict[str, DataFrame], meta: dict[str, object], path: str) -> str:
    """Publish tables and what they were made with as one unit; returns the folder of this version.

    Every call writes a version of its own. The manifest, with rows, checksum and
    schema of every table, is written last from the tables as they lie there; a
    version without a finished manifest is no version, so a bundle that broke off
    half-way is never read, and the version before it still is.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{path}/versions/{time.time_ns():020d}-{uuid.uuid4().hex}"
    listed = None
    for name, df in tables.items():
        write_json(df, f"{version}/{name}")
        row = _marks(spark.read.schema(df.schema).json(f"{version}/{name}")).select(F.lit(name).alias("name"), "rows", "checksum", F.lit(df.schema.json()).alias("schema"))
        listed = row if listed is None else listed.unionByName(row)
    write_json(spark.range(1).select(F.from_json(F.lit(json.dumps(meta)), META).alias("m")).select("m.*"), f"{version}/metadata")
    write_json(listed, f"{version}/manifest")
    return version


def current_bundle(spark: SparkSession, path: str) -> str:
    """Folder of the newest version whose manifest was finished."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/*/manifest/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    if not len(found):
        raise FileNotFoundError(f"no finished bundle in {path}")
    return f"{path}/versions/{max(f.getPath().getParent().getParent().getName() for f in found)}"


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version, with the schemas they were written with, and its metadata."""
    version = current_bundle(spark, path)
    manifest = spark.read.schema(MANIFEST).json(f"{version}/manifest").collect()  # one row for each table
    tables = {r.name: spark.read.schema(StructType.fromJson(json.loads(r.schema))).json(f"{version}/{r.name}") for r in manifest}
    return {**tables, "metadata": spark.read.schema(META).json(f"{version}/metadata")}


def check_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, intact) of every table of the current version: what the manifest says, and whether it still holds."""
    version, tables = current_bundle(spark, path), read_bundle(spark, path)
    manifest = spark.read.schema(MANIFEST).json(f"{version}/manifest")
    found = None
    for name, df in tables.items():
        if name != "metadata":
            row = _marks(df).select(F.lit(name).alias("name"), F.col("rows").alias("_rows"), F.col("checksum").alias("_checksum"))
            found = row if found is None else found.unionByName(row)
    return manifest.join(found, "name").select("name", "rows", ((F.col("rows") == F.col("_rows")) & (F.col("checksum") == F.col("_checksum"))).alias("intact"))


META = (
    "generatedAt string, bandEdges array<double>, indexWeights map<string, double>, "
    "exposureResponse struct<threshold: double, reference: double, rrAtReference: array<double>, lagWeights: array<double>>"
)


def metadata(generated_at: str, edges: tuple, weights: dict, curve) -> dict[str, object]:
    """Provenance fields of an export as plain values."""
    return {
        "generatedAt": generated_at,
        "bandEdges": list(edges),
        "indexWeights": dict(weights),
        "exposureResponse": {
            "threshold": curve.threshold,
            "reference": curve.reference,
            "rrAtReference": [curve.rr_low, curve.rr_central, curve.rr_high],
            "lagWeights": list(curve.lag_weights),
        },
    }
