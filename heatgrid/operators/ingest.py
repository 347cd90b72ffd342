"""Hourly panel: ids, time standard, quality control and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.functions import calendar, solar
from heatgrid.functions.base import no_nan
from heatgrid.operators.nearest import inverse_distance_weights
from heatgrid.params import FILL_VALUE, PHYSICAL_RANGES, VALUE_COLUMNS

FILL_TOLERANCE = 1e-2


def cell_ids(lattice: DataFrame) -> DataFrame:
    """Dense ids from 0, south-west to north-east, on the distinct (lat, lon).

    Numbering happens within a latitude and is shifted by the counts of the
    latitudes further south, so only one row per latitude is ordered globally.
    """
    points = lattice.select(F.col("lat").cast("double"), F.col("lon").cast("double")).distinct()
    rows = points.groupBy("lat").agg(F.count("*").alias("_n"))
    south = Window.orderBy("lat").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("lat", F.coalesce(F.sum("_n").over(south), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("lat").orderBy("lon")
    numbered = points.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(starts, "lat").select("lat", "lon", (F.col("_start") + F.col("_k")).cast("int").alias("cell_id"))


def without_fill_value(df: DataFrame, cols=VALUE_COLUMNS, fill: float = FILL_VALUE) -> DataFrame:
    """Missing-value marker and NaN to NULL."""
    return df.withColumns(
        {c: F.when(F.abs(F.col(c) - F.lit(fill)) >= FILL_TOLERANCE, no_nan(F.col(c))) for c in cols}
    )


def to_panel(raw: DataFrame, offsets: DataFrame) -> DataFrame:
    """Stamped file rows to the hourly panel with UTC and Indian time."""
    joined = raw.join(offsets.select("cell_id", "offset_h"), "cell_id")
    timed = joined.withColumn("ts_utc", calendar.stamp_to_utc("stamp", "offset_h"))
    panel = timed.withColumns({"ts_ist": calendar.utc_to_ist("ts_utc"), "is_interpolated": F.lit(False)})
    return without_fill_value(panel).select(
        "cell_id", "lat", "lon", "ts_utc", "ts_ist", *VALUE_COLUMNS, "is_interpolated", "year"
    )


def measure_offset(local_hours: DataFrame, min_days: int = 30) -> DataFrame:
    """Fractional UTC offset per cell from the phase of the irradiance.

    Needs ``cell_id, lon, doy, hour`` (local label, interval start) and ``sw``.
    The irradiance centroid of each day is compared with solar noon.
    """
    sw = F.when(F.col("sw") > 0, F.col("sw")).otherwise(F.lit(0.0))
    per_day = local_hours.groupBy("cell_id", "lon", "doy").agg(
        F.sum(sw * (F.col("hour") + F.lit(0.5))).alias("num"), F.sum(sw).alias("den")
    )
    lit = per_day.where("den > 0").withColumn("centroid", F.col("num") / F.col("den"))
    cell = lit.groupBy("cell_id", "lon").agg(F.median("centroid").alias("centroid"), F.count("*").alias("daylight_days"))
    noons = F.transform(F.sequence(F.lit(1), F.lit(365)), lambda d: solar.solar_noon_utc("lon", d))
    noon = F.element_at(F.array_sort(noons), 183)
    return cell.select(
        "cell_id",
        "daylight_days",
        F.when(F.col("daylight_days") >= min_days, F.col("centroid") - noon).alias("measured_h"),
    )


def calibrate_offsets(measured: DataFrame, max_residual_h: float = 0.25, strict: bool = True) -> DataFrame:
    """Whole-hour offsets; an ambiguous or unmeasurable cell stops the job."""
    out = measured.withColumn("offset_h", F.rint("measured_h").cast("int")).withColumn(
        "residual_h", F.abs(F.col("measured_h") - F.col("offset_h"))
    )
    if not strict:
        return out.withColumn("ambiguous", F.coalesce(F.col("residual_h") > max_residual_h, F.lit(True)))
    message = F.concat(F.lit("time standard is ambiguous for cell "), F.col("cell_id").cast("string"))
    good = F.coalesce(F.col("residual_h") <= max_residual_h, F.lit(False))
    return out.withColumn("offset_h", F.when(good, F.col("offset_h")).otherwise(F.raise_error(message)))


def offset_distribution(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy("offset_h").agg(F.count("*").alias("cells"), F.max("residual_h").alias("max_residual_h"))


def range_flags(cols=tuple(PHYSICAL_RANGES)) -> dict:
    """Column is outside its physical range, per variable."""
    return {f"{c}_out_of_range": ~F.col(c).between(*PHYSICAL_RANGES[c]) for c in cols}


def qc_report(hourly: DataFrame) -> DataFrame:
    """Quality figures per cell and file year in one aggregation."""
    hour = F.hour("ts_ist")
    night = (hour >= 23) | (hour <= 1)
    aggs = [F.count("*").alias("rows")]
    for c, flag in range_flags().items():
        name = c.removesuffix("_out_of_range")
        aggs += [F.count_if(F.col(name).isNull()).alias(f"{name}_nan"), F.count_if(flag).alias(c)]
    aggs += [
        F.count_if(F.col("T2MDEW") > F.col("T2M") + 0.1).alias("dewpoint_exceeds_temp"),
        F.count_if(night & (F.col("ALLSKY_SFC_SW_DWN") > 1.0)).alias("irradiance_at_midnight"),
    ]
    report = hourly.groupBy("cell_id", "year").agg(*aggs)
    return report.withColumn("rows_expected", calendar.expected_hours("year").cast("long")).withColumn(
        "rows_delta", F.col("rows") - F.col("rows_expected")
    )


def qc_summary(report: DataFrame) -> DataFrame:
    counts = [c for c in report.columns if c.endswith(("_nan", "_out_of_range")) or c.startswith(("dewpoint", "irradiance"))]
    return report.agg(
        F.count("*").alias("cell_years"),
        F.count_if(F.col("rows_delta") != 0).alias("wrong_row_count"),
        *[F.sum(c).alias(c) for c in counts],
    )


def missing_members(inventory: DataFrame) -> DataFrame:
    """(lat, lon, year) of the lattice that have no file."""
    have = inventory.select("lat", "lon", "year").distinct()
    years = have.agg(F.array_sort(F.collect_set("year"))).scalar()
    wanted = have.select("lat", "lon").distinct().withColumn("year", F.explode(years))
    return wanted.join(have, ["lat", "lon", "year"], "left_anti")


def fill_missing_cells(hourly: DataFrame, missing: DataFrame, cells: DataFrame, k: int = 4) -> DataFrame:
    """Rebuild absent cell-years from their nearest cells of the same year.

    Weights are inverse distances. The hours are those of the nearest
    neighbour, and a value is missing where any neighbour's is.
    """
    members = hourly.select("cell_id", "year").distinct().join(cells.select("cell_id", "lat", "lon"), "cell_id")
    named = missing.join(cells.select("lat", "lon", "cell_id"), ["lat", "lon"]).withColumnRenamed("cell_id", "target_id")
    weights = inverse_distance_weights(
        named, members, point_id="target_id", k=k, power=1.0, floor=1e-6, by=["year"], lon_scale=1.0
    )
    order = Window.partitionBy("year", "target_id").orderBy("distance", "cell_id")
    full = weights.withColumns(
        {
            "_nearest": F.row_number().over(order) == 1,
            "_k": F.count("*").over(Window.partitionBy("year", "target_id")),
        }
    )
    parts = hourly.select("cell_id", "year", "ts_utc", *VALUE_COLUMNS).join(full, ["cell_id", "year"])
    rebuilt = parts.groupBy("target_id", "year", "ts_utc").agg(
        F.bool_or("_nearest").alias("_on_grid"),
        *[
            F.when(F.count(c) == F.max("_k"), F.sum(F.col("weight") * F.col(c))).alias(c)
            for c in VALUE_COLUMNS
        ],
    )
    return (
        rebuilt.where("_on_grid")
        .withColumnRenamed("target_id", "cell_id")
        .join(cells.select("cell_id", "lat", "lon"), "cell_id")
        .withColumns({"ts_ist": calendar.utc_to_ist("ts_utc"), "is_interpolated": F.lit(True)})
        .select("cell_id", "lat", "lon", "ts_utc", "ts_ist", *VALUE_COLUMNS, "is_interpolated", "year")
    )
