"""Comfort-index columns that need only temperature, humidity and wind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import at_least, band, clip, col

# Band tables: fixed values.
HEAT_INDEX_BANDS = [(27.0, "Caution"), (32.0, "Extreme Caution"), (41.0, "Danger"), (54.0, "Extreme Danger")]
WBGT_BANDS = [(25.0, "Moderate"), (28.0, "High"), (30.0, "Very High"), (32.0, "Extreme")]
RISK_COLOURS = [(27.0, "Yellow (Moderate)"), (32.0, "Orange (High)"), (35.0, "Red (Severe/Extreme)")]
UTCI_BANDS = [
    (-40.0, "Very strong cold stress"),
    (-27.0, "Strong cold stress"),
    (-13.0, "Moderate cold stress"),
    (0.0, "Slight cold stress"),
    (9.0, "No thermal stress"),
    (26.0, "Moderate heat stress"),
    (32.0, "Strong heat stress"),
    (38.0, "Very strong heat stress"),
    (46.0, "Extreme heat stress"),
]

# Rothfusz regression terms as (power of temperature, power of humidity, weight): fixed values.
ROTHFUSZ = [
    (0, 0, -42.379),
    (1, 0, 2.04901523),
    (0, 1, 10.14333127),
    (1, 1, -0.22475541),
    (2, 0, -0.00683783),
    (0, 2, -0.05481717),
    (2, 1, 0.00122874),
    (1, 2, 0.00085282),
    (2, 2, -0.00000199),
]


def heat_index(t, rh) -> Column:
    """US Weather Service heat index in degC."""
    f = col(t) * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
    h = clip(rh, 0.0, 100.0)
    simple = F.lit(0.5) * (f + F.lit(61.0) + (f - F.lit(68.0)) * F.lit(1.2) + h * F.lit(0.094))

    powers = {0: lambda x: None, 1: lambda x: x, 2: lambda x: x * x}
    full = F.lit(0.0)
    for pt, ph, weight in ROTHFUSZ:
        term = F.lit(weight)
        for factor in (powers[pt](f), powers[ph](h)):
            term = term if factor is None else term * factor
        full = full + term

    dryness = (F.lit(13.0) - h) / F.lit(4.0)
    dry = dryness * F.sqrt(F.greatest((F.lit(17.0) - F.abs(f - F.lit(95.0))) / F.lit(17.0), F.lit(0.0)))
    humid = (h - F.lit(85.0)) / F.lit(10.0) * ((F.lit(87.0) - f) / F.lit(5.0))
    adjusted = (
        F.when((h < 13.0) & f.between(80.0, 112.0), full - dry)
        .when((h > 85.0) & f.between(80.0, 87.0), full + humid)
        .otherwise(full)
    )
    chosen = F.when((simple + f) / F.lit(2.0) >= 80.0, adjusted).otherwise(simple)
    return (chosen - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def heat_index_category(hi) -> Column:
    return band(hi, HEAT_INDEX_BANDS, "Safe")


def wbgt_shade(t, rh) -> Column:
    """Shade approximation of WBGT; humidity and temperature only."""
    t = col(t)
    e = clip(rh, 0.0, 100.0) / F.lit(100.0) * F.lit(6.105) * F.exp(F.lit(17.27) * t / (F.lit(237.7) + t))
    return F.lit(0.567) * t + F.lit(0.393) * e + F.lit(3.94)


def wbgt_category(w) -> Column:
    return band(w, WBGT_BANDS, "Low")


def wbgt_risk_colour(w) -> Column:
    w = col(w)
    return F.when(w.isNotNull(), band(w, RISK_COLOURS, "Green (Low)"))


def utci_category(u) -> Column:
    return band(u, UTCI_BANDS, "Extreme cold stress")


def wbgt_outdoor(natural_wet_bulb, globe, t) -> Column:
    return F.lit(0.7) * col(natural_wet_bulb) + F.lit(0.2) * col(globe) + F.lit(0.1) * col(t)


def non_negative(c) -> Column:
    return at_least(c, 0.0)
