"""Radiation budget columns: absorbed shortwave and mean radiant temperature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import at_least, clip, col

# Physical constants: fixed values.
KELVIN = 273.15
STEFAN_BOLTZMANN = 5.67e-8
SOLAR_CONSTANT = 1367.0
MIN_COS_ZENITH = 0.0873
SURFACE_ALBEDO = 0.20
SURFACE_EMISSIVITY = 0.999
GLOBE_DIAMETER_M = 0.15
GLOBE_EMISSIVITY = 0.95
GLOBE_ALBEDO = 0.05
WICK_ALBEDO = 0.15
HUMAN_ABSORPTIVITY = 0.70
HUMAN_EMISSIVITY = 0.97


def bounded_irradiance(ghi, cosz) -> Column:
    """Global irradiance, at most a little above what reaches the atmosphere."""
    return F.least(at_least(ghi, 0.0), F.lit(1.1 * SOLAR_CONSTANT) * col(cosz))


def beam_normal(total, cosz, direct_fraction) -> Column:
    """Beam on a plane that faces the sun; none from a sun near the horizon."""
    steep = col(direct_fraction) * col(total) / F.greatest(col(cosz), F.lit(MIN_COS_ZENITH))
    return F.when(col(cosz) < MIN_COS_ZENITH, F.lit(0.0)).otherwise(F.least(steep, F.lit(SOLAR_CONSTANT)))


def diffuse(total, direct_fraction) -> Column:
    return F.greatest(col(total) * (F.lit(1.0) - col(direct_fraction)), F.lit(0.0))


def absorbed_shortwave(total, beam, sky, albedo_body: float) -> Column:
    """Mean shortwave flux absorbed by a sphere, W/m2."""
    return F.lit(1.0 - albedo_body) * (
        col(beam) / F.lit(4.0) + col(sky) / F.lit(2.0) + F.lit(SURFACE_ALBEDO / 2.0) * col(total)
    )


def sky_emissivity(vapour_kpa) -> Column:
    return clip(F.lit(0.575) * F.pow(at_least(vapour_kpa, 1e-4) * F.lit(10.0), F.lit(1.0 / 7.0)), 0.5, 1.0)


def projected_area_factor(cosz) -> Column:
    """Share of a standing person's surface facing the sun."""
    elevation = F.degrees(F.asin(clip(cosz, 0.0, 1.0)))
    return F.lit(0.308) * F.cos(F.radians(elevation * (F.lit(0.998) - elevation * elevation / F.lit(50000.0))))


def mean_radiant_temperature(globe, t, wind, diameter_m: float = GLOBE_DIAMETER_M) -> Column:
    """Mean radiant temperature by inverting a black globe (ISO 7726)."""
    tg = col(globe)
    factor = F.lit(1.10e8 / (GLOBE_EMISSIVITY * diameter_m**0.4)) * F.pow(at_least(wind, 0.0), F.lit(0.6))
    inner = F.pow(tg + F.lit(KELVIN), F.lit(4.0)) + factor * (tg - col(t))
    return F.pow(at_least(inner, 1.0), F.lit(0.25)) - F.lit(KELVIN)


def mean_radiant_temperature_human(t, emissivity, total, beam, sky, area_factor) -> Column:
    """Mean radiant temperature of a standing person from the radiation budget."""
    shortwave = F.lit(HUMAN_ABSORPTIVITY) * (
        col(area_factor) * col(beam) + F.lit(0.5) * col(sky) + F.lit(0.5 * SURFACE_ALBEDO) * col(total)
    )
    longwave = F.lit(0.5) * F.pow(col(t) + F.lit(KELVIN), F.lit(4.0)) * (col(emissivity) + F.lit(SURFACE_EMISSIVITY))
    budget = shortwave / F.lit(HUMAN_EMISSIVITY * STEFAN_BOLTZMANN) + longwave
    return F.pow(F.when(budget < 1.0, F.lit(1.0)).otherwise(budget), F.lit(0.25)) - F.lit(KELVIN)
