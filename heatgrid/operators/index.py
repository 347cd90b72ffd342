"""The 0-100 composite stress index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.functions import scaling
from heatgrid.operators.climatology import spell_length
from heatgrid.operators.ranking import exact_quantiles
from heatgrid.params import IndexWeights


def compute_index(
    daily: DataFrame,
    weights: IndexWeights | None = None,
    value: str = "wbgt_max",
    utci: str = "utci_max",
    night: str = "wbgt_night_min",
    calendar: bool = False,
) -> DataFrame:
    """Four components, gate, spell length, index and band per cell-day.

    ``daily`` must carry the anomaly rank; a stored 90th percentile marks hot
    days, otherwise a rank of 90 does.
    """
    missing = [c for c in (f"{value}_pct_rank", utci, night) if c not in daily.columns]
    if missing:
        raise KeyError(f"the index needs {missing}; attach the climatology first")
    return score(spell_length(daily, hot_day(daily, value), calendar=calendar), weights, value, utci, night)


def hot_day(daily: DataFrame, value: str = "wbgt_max") -> Column:
    """Whether a day counts towards a spell."""
    rank, p90 = f"{value}_pct_rank", f"{value}_p90"
    return F.col(value) >= F.col(p90) if p90 in daily.columns else F.col(rank) >= 90.0


def score(spells: DataFrame, weights: IndexWeights | None = None, value: str = "wbgt_max", utci: str = "utci_max", night: str = "wbgt_night_min") -> DataFrame:
    """Components, index and band of days that carry their anomaly rank and ``spell_days``."""
    weights = weights or IndexWeights()
    rank, w, gate = f"{value}_pct_rank", weights.normalised(), scaling.physiological_gate(value)
    parts = spells.withColumns(
        {
            "htsi_gate": gate,
            "htsi_intensity": scaling.scale_intensity(utci),
            "htsi_anomaly": scaling.scale_anomaly(rank) * gate,
            "htsi_night": scaling.scale_night_relief(
                F.coalesce(F.col(night), F.lit(0.0)), weights.night_relief_threshold_c
            ),
            "htsi_duration": scaling.scale_duration("spell_days", weights.duration_saturation_days) * gate,
        }
    )
    total = (
        F.lit(w["intensity"]) * F.col("htsi_intensity")
        + F.lit(w["anomaly"]) * F.col("htsi_anomaly")
        + F.lit(w["night_relief"]) * F.col("htsi_night")
        + F.lit(w["duration"]) * F.col("htsi_duration")
    )
    return parts.withColumn("htsi", total).withColumn("htsi_band", scaling.stress_band("htsi"))


def calibrate_edges(daily: DataFrame, percentiles=(90.0, 97.0, 99.0), months=(3, 4, 5, 6), value: str = "htsi") -> DataFrame:
    """Percentiles of the summer index that serve as band edges."""
    summer = daily.where(F.month("date").isin(list(months)))
    return exact_quantiles(summer, value, [p / 100.0 for p in percentiles], [f"edge_p{int(p)}" for p in percentiles])


def top_share_by_season(daily: DataFrame, top: float = 0.99, value: str = "htsi") -> DataFrame:
    """Share of days in the overall top percent, per calendar quarter."""
    cut = exact_quantiles(daily, value, [top], ["cut"]).scalar()
    return daily.groupBy(F.quarter("date").alias("quarter")).agg(
        F.count("*").alias("days"),
        F.avg((F.col(value) >= cut).cast("double")).alias("top_share"),
    )
