"""Piecewise scalings, percentile ranks, band edges and risk curves."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import at_least, band, clip, col
from heatgrid.functions import psychro  # noqa: F401  (re-exported for notebooks)
from heatgrid.params import BAND_EDGES, LEVELS, ExposureResponse, HeatIslandParams, IndexWeights

# Knots of the two piecewise-linear scalings: fixed values.
INTENSITY_KNOTS = [(9.0, 0.0), (26.0, 25.0), (32.0, 45.0), (38.0, 65.0), (46.0, 85.0), (55.0, 100.0)]
ANOMALY_KNOTS = [(0.0, 0.0), (80.0, 10.0), (90.0, 40.0), (95.0, 65.0), (98.0, 85.0), (100.0, 100.0)]
GATE_START_C, GATE_WIDTH_C = 27.0, 4.0
NIGHT_FULL_DEFICIT_C = 6.0
DURATION_RATE = 1.6


def interp(c, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation through (x, y) knots, flat outside them."""
    x = col(c)
    chain = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        chain = chain.when(x <= x1, F.lit(y0) + F.lit((y1 - y0) / (x1 - x0)) * (x - F.lit(x0)))
    return chain.otherwise(F.lit(knots[-1][1]))


def scale_intensity(utci_max) -> Column:
    return interp(utci_max, INTENSITY_KNOTS)


def scale_anomaly(pct_rank) -> Column:
    return interp(pct_rank, ANOMALY_KNOTS)


def scale_night_relief(night_min, threshold: float = IndexWeights.night_relief_threshold_c) -> Column:
    return clip((col(night_min) - F.lit(threshold)) / F.lit(NIGHT_FULL_DEFICIT_C) * F.lit(100.0), 0.0, 100.0)


def scale_duration(spell_days, saturation: int = IndexWeights.duration_saturation_days) -> Column:
    share = at_least(col(spell_days).cast("double"), 0.0) / F.lit(float(max(saturation, 1)))
    return clip(F.lit(100.0) * (F.lit(1.0) - F.exp(F.lit(-DURATION_RATE) * share)), 0.0, 100.0)


def physiological_gate(wbgt_max) -> Column:
    return clip((col(wbgt_max) - F.lit(GATE_START_C)) / F.lit(GATE_WIDTH_C), 0.0, 1.0)


def stress_band(htsi) -> Column:
    return band(htsi, list(zip(BAND_EDGES, LEVELS[1:])), LEVELS[0])


def level_number(band_col) -> Column:
    """0 for Normal up to 3 for Emergency; unknown labels count as 0."""
    c = col(band_col)
    chain = F
    for i, name in enumerate(LEVELS[1:], start=1):
        chain = chain.when(c == name, F.lit(i))
    return chain.otherwise(F.lit(0))


def level_name(level) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), col(level) + F.lit(1))


def percentile_rank(value, breaks: list[tuple[float, Column]]) -> Column:
    """Rank of a value within stored percentiles, 0..100.

    Proportional below the first stored percentile; above the last one the
    width of the last segment serves as the ruler for the remaining headroom.
    """
    v = col(value)
    (p_first, b_first), (p_last, b_last) = breaks[0], breaks[-1]
    tiny = F.lit(1e-6)
    chain = F.when(v.isNull() | b_first.isNull(), F.lit(None).cast("double")).when(
        v <= b_first, F.lit(p_first) * v / F.greatest(b_first, tiny)
    )
    for (p0, b0), (p1, b1) in zip(breaks, breaks[1:]):
        chain = chain.when(v <= b1, F.lit(p0) + F.lit(p1 - p0) * (v - b0) / F.greatest(b1 - b0, tiny))
    ruler = F.greatest(b_last - breaks[-2][1], tiny)
    chain = chain.otherwise(F.lit(p_last) + F.lit(100.0 - p_last) * (v - b_last) / ruler)
    return clip(chain, 0.0, 100.0)


def probability_exceeding(q10, q50, q90, threshold) -> Column:
    """P(Y >= threshold) from three quantiles with a linear distribution function."""
    lo, mid, hi = col(q10), col(q50), col(q90)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    below = F.lit(0.5) - (mid - t) * (F.lit(0.4) / F.greatest(mid - lo, F.lit(1e-3)))
    above = F.lit(0.5) + (t - mid) * (F.lit(0.4) / F.greatest(hi - mid, F.lit(1e-3)))
    return F.lit(1.0) - clip(F.when(t <= mid, below).otherwise(above), 0.0, 1.0)


def ordered_quantiles(q10, q50, q90) -> tuple[Column, Column, Column]:
    """Clip to 0..100 and stop the quantiles from crossing."""
    mid = clip(q50, 0.0, 100.0)
    return clip(F.least(col(q10), mid), 0.0, 100.0), mid, clip(F.greatest(col(q90), mid), 0.0, 100.0)


def lagged_log_risk(lags: list, curve: ExposureResponse, which: str = "central") -> Column:
    """Distributed-lag log relative risk; a missing lag is no exposure."""
    total = F.lit(0.0)
    for weight, lag in zip(curve.lag_weights, lags):
        total = total + F.lit(weight) * F.greatest(F.coalesce(col(lag), F.lit(0.0)) - F.lit(curve.threshold), F.lit(0.0))
    return F.least(F.lit(curve.slope(which)) * total, F.lit(math.log(curve.max_rr)))


def relative_risk(log_risk, vulnerability) -> Column:
    return F.exp(col(vulnerability) * col(log_risk))


def mortality_risk_index(rr, curve: ExposureResponse | None = None) -> Column:
    c = curve or ExposureResponse()
    return clip(F.lit(100.0) * (col(rr) - F.lit(1.0)) / F.lit(c.mri_reference_excess), 0.0, 100.0)


def per_100k(count, population) -> Column:
    return F.lit(100000.0) * col(count) / col(population)


def heat_island(built_up, utci, night_wbgt, p: HeatIslandParams | None = None) -> dict[str, Column]:
    """Day and night uplift of a built-up place and the index points they add."""
    p = p or HeatIslandParams()
    w = IndexWeights().normalised()
    b = clip(built_up, 0.0, 1.0)
    d_day = F.lit(p.a_day) + F.lit(p.b_day) * b
    d_night = F.lit(p.a_night) + F.lit(p.b_night) * b
    warm_utci = col(utci) + d_day
    warm_night = col(night_wbgt) + F.lit(p.wbgt_per_degc) * d_night
    points = F.lit(w["intensity"]) * (scale_intensity(warm_utci) - scale_intensity(utci)) + F.lit(
        w["night_relief"]
    ) * (scale_night_relief(warm_night) - scale_night_relief(night_wbgt))
    return {"d_day": d_day, "d_night": d_night, "utci": warm_utci, "night_wbgt": warm_night, "d_htsi": points}


def interventions_keep(covered: Column, work_hours: bool, advisories: bool, p) -> Column:
    """Share of excess deaths that remains after the chosen measures."""
    keep = F.when(covered, F.lit(1.0 - p.cooling_centre)).otherwise(F.lit(1.0))
    for on, averted in ((work_hours, p.work_hours), (advisories, p.advisories)):
        keep = keep * F.lit(1.0 - averted if on else 1.0)
    return keep


def scaled_threshold(threshold, k: float) -> Column:
    return F.least(F.lit(0.95), col(threshold) * F.lit(float(k)))
