"""Moist-air columns. Temperatures in degC, pressures in kPa, wind in m/s."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import at_least, at_most, clip, col

# Buck (1981) saturation curve over water: fixed values.
BUCK_A, BUCK_B, BUCK_C, BUCK_D = 0.61121, 18.678, 234.5, 257.14


def saturation_vapour_pressure(t) -> Column:
    """Saturation vapour pressure over water, kPa."""
    t = col(t)
    return F.lit(BUCK_A) * F.exp((F.lit(BUCK_B) - t / F.lit(BUCK_C)) * (t / (F.lit(BUCK_D) + t)))


def vapour_pressure(t, dewpoint, clamp: bool = True) -> Column:
    """Actual vapour pressure; the dewpoint may not exceed the air temperature."""
    td = at_most(col(dewpoint), col(t)) if clamp else col(dewpoint)
    return saturation_vapour_pressure(td)


def relative_humidity(t, dewpoint) -> Column:
    ratio = F.lit(100.0) * vapour_pressure(t, dewpoint) / saturation_vapour_pressure(t)
    return clip(ratio, 0.0, 100.0)


def dewpoint_from_rh(t, rh) -> Column:
    """Inverse of the Buck curve: Magnus start, then three Newton steps.

    The steps are chained through a one-element ``transform`` so that each
    iterate is evaluated once instead of being inlined many times over.
    """
    target = clip(rh, 1e-3, 100.0) / F.lit(100.0) * saturation_vapour_pressure(t)

    def newton(goal: Column):
        step = 1e-4

        def run(x: Column, _k: Column) -> Column:
            rise = saturation_vapour_pressure(x + F.lit(step)) - saturation_vapour_pressure(x - F.lit(step))
            slope = F.greatest(rise / F.lit(2 * step), F.lit(1e-12))
            return x - (saturation_vapour_pressure(x) - goal) / slope

        return run

    def solve(goal: Column) -> Column:
        ln = F.log(goal / F.lit(BUCK_A))
        start = F.lit(BUCK_D) * ln / (F.lit(BUCK_B) - ln)
        return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), start, newton(goal))

    return F.when(target.isNotNull(), F.element_at(F.transform(F.array(target), solve), 1))


def specific_humidity(vapour, pressure) -> Column:
    e, p = col(vapour), col(pressure)
    return F.lit(0.622) * e / at_least(p - F.lit(0.378) * e, 1e-6)


def wind_at_height(
    wind, from_m: float = 10.0, to_m: float = 2.0, roughness_m: float = 0.03, floor_ms: float = 0.13
) -> Column:
    """Log-profile wind at another height with a calm-air floor."""
    ratio = math.log(to_m / roughness_m) / math.log(from_m / roughness_m)
    return at_least(col(wind) * F.lit(ratio), floor_ms)


def apparent_temperature(t, rh, wind) -> Column:
    """Steadman apparent temperature with vapour pressure in hPa."""
    t = col(t)
    e = col(rh) / F.lit(100.0) * F.lit(6.105) * F.exp(F.lit(17.27) * t / (F.lit(237.7) + t))
    return t + F.lit(0.33) * e - F.lit(0.70) * col(wind) - F.lit(4.0)
