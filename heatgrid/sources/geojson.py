"""Feature collections: reading under contract and writing layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.functions import geo
from heatgrid.operators.places import resolve_keys

# Ward contract: fixed values.
REQUIRED = ("ward_id", "ward_name", "ulb_name", "district")
OPTIONAL = ("population", "elderly_pct", "slum_pop_pct", "built_up_frac", "ndvi")
DEFAULTS = {"built_up_frac": 0.5, "ndvi": 0.3, "slum_pop_pct": 15.0}
SHOWN_PROBLEMS = 20

FEATURE_SCHEMA = (
    "struct<type: string, properties: struct<ward_id: string, ward_name: string, ulb_name: string, district: string, "
    "population: double, elderly_pct: double, slum_pop_pct: double, built_up_frac: double, ndvi: double>, "
    "geometry: struct<type: string, coordinates: string>>"
)
RING_SCHEMA = "array<array<array<double>>>"
MULTI_SCHEMA = "array<array<array<array<double>>>>"


class ContractError(ValueError):
    """The supplied features break the contract; nothing was loaded."""


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of collection documents, one row each."""
    docs = spark.read.schema(f"type string, features array<{FEATURE_SCHEMA}>").option("multiLine", True).json(path)
    return docs.select(F.posexplode("features").alias("feature_no", "feature"))


def parse_features(df: DataFrame, key: str, json: str) -> DataFrame:
    """Features from one JSON text per row (newline-delimited form)."""
    return df.select(F.col(key).alias("feature_no"), F.from_json(F.col(json), FEATURE_SCHEMA).alias("feature"))


def outer_ring() -> Column:
    """Outer ring of a polygon, or of the first part of a multi-polygon."""
    kind, coords = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")
    single = F.try_element_at(F.from_json(coords, RING_SCHEMA), F.lit(1))
    multi = F.try_element_at(F.try_element_at(F.from_json(coords, MULTI_SCHEMA), F.lit(1)), F.lit(1))
    return F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multi)


def check_features(features: DataFrame, walk: DataFrame) -> DataFrame:
    """Features with the district code, the outer ring and every broken rule."""
    p = "feature.properties"
    blank = lambda c: F.coalesce(F.trim(F.col(f"{p}.{c}")) == "", F.lit(True))
    keyed = resolve_keys(features.withColumn("_district", F.col(f"{p}.district")), "_district", walk, on_unknown="null")
    rows = keyed.withColumns({"ward_id": F.col(f"{p}.ward_id"), "ring": outer_ring()})
    again = rows.where("ward_id IS NOT NULL").groupBy("ward_id").agg(F.min("feature_no").alias("_first"))
    joined = rows.join(again, "ward_id", "left")
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in REQUIRED]))
    rules = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing required "), F.array_join(missing, ","))),
            F.when(F.col("_first") < F.col("feature_no"), F.concat(F.lit("duplicate ward_id "), F.col("ward_id"))),
            F.when(F.col("ahs_code").isNull() & ~blank("district"), F.concat(F.lit("unresolvable district "), F.col("_district"))),
            F.when(F.coalesce(F.size("ring") < 4, F.lit(True)), F.lit("geometry must be Polygon or MultiPolygon")),
        )
    )
    return joined.withColumn("problems", rules).drop("_first", "_district")


def load_wards(features: DataFrame, walk: DataFrame, elderly: DataFrame) -> DataFrame:
    """Wards under an all-or-nothing contract; optional gaps are filled and named.

    ``elderly``: ``ahs_code, elderly_pct`` of the districts.
    """
    checked = check_features(features, walk)
    broken = sample_violations(checked.where(F.size("problems") > 0).select("feature_no", "problems"), "feature_no")
    if broken:
        listed = "\n  ".join(f"feature {r[0]}: {'; '.join(r[1])}" for r in broken)
        raise ContractError(f"problems in the ward features, nothing was loaded:\n  {listed}")
    return ward_rows(checked, elderly)


def sample_violations(df: DataFrame, order: str, n: int = SHOWN_PROBLEMS) -> list:
    """The first few offenders for an error message."""
    return df.orderBy(order).limit(n).collect()


def ward_rows(checked: DataFrame, elderly: DataFrame) -> DataFrame:
    p = "feature.properties"
    joined = checked.join(elderly.select("ahs_code", F.col("elderly_pct").alias("_elderly")), "ahs_code", "left")
    fallback = {**{c: F.lit(v) for c, v in DEFAULTS.items()}, "elderly_pct": F.col("_elderly"), "population": F.lit(None).cast("double")}
    centre = geo.ring_centroid("ring")
    filled = F.concat_ws(",", *[F.when(F.col(f"{p}.{c}").isNull(), F.lit(c)) for c in OPTIONAL])
    rows = joined.withColumn("_c", centre)
    return rows.select(
        "ward_id",
        F.col(f"{p}.ward_name").alias("ward_name"),
        F.col(f"{p}.ulb_name").alias("ulb_name"),
        F.col(f"{p}.ulb_name").alias("city"),
        "ahs_code",
        F.col("_c.lat").alias("lat"),
        F.col("_c.lon").alias("lon"),
        geo.ring_area_km2("ring", "_c.lat").alias("area_km2"),
        *[F.coalesce(F.col(f"{p}.{c}"), fallback[c]).alias(c) for c in OPTIONAL],
        F.lit(False).alias("synthetic"),
        filled.alias("filled_fields"),
        "ring",
    )


def ward_feature(ring: str = "ring") -> Column:
    """GeoJSON feature of a ward row as JSON text."""
    properties = F.struct(
        F.col("ward_id").alias("id"), F.col("ward_name").alias("name"), "city", F.col("ahs_code").alias("district"),
        F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.col("population").cast("long").alias("population"),
        F.round("elderly_pct", 1).alias("elderlyPct"), F.round("slum_pop_pct", 1).alias("slumPct"),
        F.round("built_up_frac", 3).alias("builtUp"), F.round("ndvi", 3).alias("ndvi"), F.round("area_km2", 2).alias("areaKm2"),
    )
    return _feature(F.col(ring), properties)


def cell_feature(resolution: float = 0.25) -> Column:
    """GeoJSON feature of a grid cell as JSON text."""
    properties = F.struct(F.col("cell_id").alias("id"), "lat", "lon", F.col("ahs_code").alias("district"))
    return _feature(geo.square_ring("lat", "lon", resolution), properties)


def _feature(ring: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
