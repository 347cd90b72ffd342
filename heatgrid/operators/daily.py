"""Hourly weather -> thermal indices -> one record per cell and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgrid.functions import calendar, heat, psychro, radiation, solar, solvers, utci
from heatgrid.functions.base import at_least, no_nan
from heatgrid.params import DEGREE_HOUR_THRESHOLD, NIGHT_END_HOUR, NIGHT_START_HOUR, WBGT_HOUR_THRESHOLDS

DAILY_INDICES = ("t2m", "wbgt", "utci", "heat_index", "tmrt", "wbgt_shade")
NIGHT_INDICES = ("t2m", "wbgt", "utci")


def with_sun(df: DataFrame, ts: str = "ts_utc", lat: str = "lat", lon: str = "lon", ghi: str = "ghi") -> DataFrame:
    """Add ``cosz, dni, dhi, direct_fraction``, the sun taken at mid-hour.

    Each step is its own projection, so every quantity is computed once and the
    generated code stays small.
    """
    mid = F.col(ts) + F.expr("INTERVAL 30 MINUTES")
    hours = F.hour("_mid") + F.minute("_mid") / F.lit(60.0) + F.second("_mid") / F.lit(3600.0)
    beam = F.greatest(F.col("_g") - F.col("dhi"), F.lit(0.0))
    steps = [
        {"_mid": mid, "_g": F.greatest(F.coalesce(F.col(ghi), F.lit(0.0)), F.lit(0.0))},
        {"_angle": solar.year_angle(F.dayofyear("_mid")), "_hours": hours},
        {"_decl": solar.declination("_angle"), "_noon": solar.noon_at(lon, "_angle"), "_top": solar.extraterrestrial("_angle")},
        {"cosz": solar.cos_zenith(lat, "_decl", "_hours", "_noon")},
        {"_kt": solar.clearness("_g", "_top", "cosz")},
        {"dhi": F.when(solar.low_sun("cosz"), F.col("_g")).otherwise(F.col("_g") * solar.diffuse_share("_kt"))},
        {"_beam": beam},
        {"dni": solar.beam_normal("_beam", "cosz"), "direct_fraction": solar.direct_fraction("_beam", "_g")},
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.drop("_mid", "_g", "_angle", "_hours", "_decl", "_noon", "_top", "_kt", "_beam")


def with_radiation(df: DataFrame, t: str = "t2m", dewpoint: str = "td", ghi: str = "ghi") -> DataFrame:
    """Add vapour pressure, sky emissivity, absorbed shortwave and human ``tmrt``."""
    parts = ("_total", "_beam", "_sky")
    steps = [
        {"vapour": psychro.vapour_pressure(t, dewpoint), "_total": radiation.bounded_irradiance(ghi, "cosz")},
        {
            "emissivity": radiation.sky_emissivity("vapour"),
            "_beam": radiation.beam_normal("_total", "cosz", "direct_fraction"),
            "_sky": radiation.diffuse("_total", "direct_fraction"),
            "area_factor": radiation.projected_area_factor("cosz"),
        },
        {
            "sw_globe": radiation.absorbed_shortwave(*parts, radiation.GLOBE_ALBEDO),
            "sw_wick": radiation.absorbed_shortwave(*parts, radiation.WICK_ALBEDO),
            "tmrt": radiation.mean_radiant_temperature_human(t, "emissivity", *parts, "area_factor"),
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*parts)


def hourly_indices(hourly: DataFrame) -> DataFrame:
    """All thermal indices in one pass over the hourly table; no shuffle.

    Needs ``cell_id, lat, lon, ts_utc, ts_ist`` and the weather columns. The two
    implicit balances and the regression run in a single Arrow exchange.
    """
    weather = {"t2m": "T2M", "td": "T2MDEW", "ws10": "WS10M", "ps": "PS", "ghi": "ALLSKY_SFC_SW_DWN"}
    base = hourly.select(
        "cell_id", "ts_ist", "ts_utc", "lat", "lon", *[no_nan(F.col(src).cast("double")).alias(c) for c, src in weather.items()]
    )
    humid = base.withColumns({"rh": psychro.relative_humidity("t2m", "td"), "ws2": psychro.wind_at_height("ws10")})
    ready = with_radiation(with_sun(humid))
    solved = ready.withColumns(
        {
            "tg": solvers.globe_temperature("t2m", "ws2", "ps", "sw_globe", "emissivity"),
            "tnwb": solvers.natural_wet_bulb("t2m", "td", "ws2", "ps", "sw_wick", "emissivity", "vapour"),
            "utci": utci.utci("t2m", "tmrt", "ws10", "rh"),
        }
    )
    return solved.select(
        "cell_id",
        "ts_ist",
        "t2m",
        "rh",
        heat.wbgt_outdoor("tnwb", "tg", "t2m").alias("wbgt"),
        "tg",
        "tnwb",
        "tmrt",
        radiation.mean_radiant_temperature("tg", "t2m", "ws2").alias("tmrt_globe"),
        "utci",
        heat.heat_index("t2m", "rh").alias("heat_index"),
        heat.wbgt_shade("t2m", "rh").alias("wbgt_shade"),
    )


def exceedance_counts(value: str, thresholds: Sequence[float], prefix: str) -> list[Column]:
    return [F.count_if(F.col(value) >= F.lit(t)).alias(f"{prefix}{int(t)}") for t in thresholds]


def degree_hours(value: str, threshold: float = DEGREE_HOUR_THRESHOLD) -> Column:
    return F.coalesce(F.sum(at_least(F.col(value) - F.lit(threshold), 0.0)), F.lit(0.0))


def daily_aggregates(indices: Sequence[str]) -> list[Column]:
    return [f(c).alias(f"{c}_{n}") for c in indices for n, f in (("max", F.max), ("mean", F.avg), ("min", F.min))]


def day_statistics(indices: Sequence[str], ts: str = "ts_ist") -> list[Column]:
    """Aggregates of a day's hours; the night's two parts stand on the date they fall on."""
    hour = F.hour(ts)
    night = [c for c in NIGHT_INDICES if c in indices]
    return [
        *daily_aggregates(indices),
        *[F.min(F.when(hour >= NIGHT_START_HOUR, F.col(c))).alias(f"{c}_evening") for c in night],
        *[F.min(F.when(hour < NIGHT_END_HOUR, F.col(c))).alias(f"{c}_morning") for c in night],
        degree_hours("wbgt").alias("wbgt_degree_hours"),
        *exceedance_counts("wbgt", WBGT_HOUR_THRESHOLDS, "wbgt_hours_above_"),
    ]


def aggregate_daily(hourly: DataFrame, indices: Sequence[str] = DAILY_INDICES) -> DataFrame:
    """One row per (cell, local date) with statistics, night minima and heat hours.

    The hourly rows are read and shuffled once. A night spans two dates, so its
    evening and morning minima are taken on the date they fall on and combined
    on the small daily result.
    """
    night = [c for c in NIGHT_INDICES if c in indices]
    per_day = hourly.groupBy("cell_id", F.to_date("ts_ist").alias("date")).agg(*day_statistics(indices))
    w = Window.partitionBy("cell_id").orderBy("date")
    adjacent = F.lag("date").over(w) == F.date_sub("date", 1)
    minima = {
        f"{c}_night_min": F.least(F.col(f"{c}_morning"), F.when(adjacent, F.lag(f"{c}_evening").over(w)))
        for c in night
    }
    return per_day.withColumns(minima).drop(*[f"{c}_{part}" for c in night for part in ("evening", "morning")])


def night_minimum(
    hourly: DataFrame, cols: Sequence[str] = NIGHT_INDICES, start: int = NIGHT_START_HOUR, end: int = NIGHT_END_HOUR
) -> DataFrame:
    """Night minima alone, keyed by the date the night ends on."""
    key = calendar.night_date("ts_ist", start, end)
    return (
        hourly.where((F.hour("ts_ist") >= start) | (F.hour("ts_ist") < end))
        .groupBy("cell_id", key.alias("date"))
        .agg(*[F.min(c).alias(f"{c}_night_min") for c in cols])
    )


def attach_coords(daily: DataFrame, cells: DataFrame) -> DataFrame:
    return daily.join(distinct_cells(cells), "cell_id", "left")


def distinct_cells(df: DataFrame) -> DataFrame:
    """One row per cell; the smallest coordinates win, whatever the row order."""
    return df.groupBy("cell_id").agg(F.min(F.struct("lat", "lon")).alias("_c")).select("cell_id", "_c.lat", "_c.lon")


def band_shares(df: DataFrame, band: str) -> DataFrame:
    """Count and share of every label."""
    counts = df.groupBy(band).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def clipping_report(hourly: DataFrame, t: str = "t2m", radiant: str = "tmrt", wind: str = "ws10") -> DataFrame:
    """How many rows fall outside the fitted range of the climate index."""
    d = F.col(radiant) - F.col(t)
    lo, hi = utci.RADIANT_EXCESS
    w_lo, w_hi = utci.WIND_RANGE
    return hourly.agg(
        F.count("*").alias("n"),
        F.count_if(d < lo).alias("tmrt_delta_below"),
        F.count_if(d > hi).alias("tmrt_delta_above"),
        F.count_if(F.col(wind) < w_lo).alias("wind_below"),
        F.count_if(F.col(wind) > w_hi).alias("wind_above"),
    )


def alert_rate_compare(hourly: DataFrame, threshold: float = 35.0, value: str = "wbgt") -> DataFrame:
    """Share of cell-days above the threshold: indices hourly-first against daily-first."""
    both = hourly.groupBy("cell_id", F.to_date("ts_ist").alias("date")).agg(
        F.max(value).alias("hourly_first"), F.max("t2m").alias("t2m_max"), F.avg("rh").alias("rh_mean")
    ).withColumn("daily_first", heat.wbgt_shade("t2m_max", "rh_mean"))
    share = lambda c: F.avg((F.col(c) > threshold).cast("double"))
    return both.agg(
        F.count("*").alias("cell_days"),
        share("hourly_first").alias("hourly_first_rate"),
        share("daily_first").alias("daily_first_rate"),
    )


def legacy_daily(master: DataFrame) -> DataFrame:
    """Daily master table (``YEAR, DOY`` and daily weather) with three indices and a colour."""
    dated = master.withColumns(
        {
            "date": calendar.date_of_year_day("YEAR", "DOY"),
            "T2M_MEAN": (F.col("T2M_MAX") + F.col("T2M_MIN")) / F.lit(2.0),
        }
    ).withColumns(
        {
            "month": F.month("date"),
            "HI_C": heat.heat_index("T2M_MAX", "RH2M"),
            "WBGT": heat.wbgt_shade("T2M_MAX", "RH2M"),
            "AT_C": psychro.apparent_temperature("T2M_MAX", "RH2M", "WS10M"),
        }
    )
    return dated.withColumn("WBGT_Risk", heat.wbgt_risk_colour("WBGT"))
