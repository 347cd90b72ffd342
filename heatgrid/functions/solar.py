"""Solar geometry and the beam/diffuse split as closed-form columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import clip, col, polynomial

# Spencer (1971) Fourier coefficients, per harmonic (cos, sin): fixed values.
EQUATION_OF_TIME = (0.000075, [(0.001868, -0.032077), (-0.014615, -0.040849)])
DECLINATION = (0.006918, [(-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148)])
DISTANCE = (1.00011, [(0.034221, 0.00128), (0.000719, 0.000077)])
EOT_MINUTES = 229.18
EXTRATERRESTRIAL = 1366.1

# Erbs (1982) diffuse fraction of the clearness index: fixed values.
ERBS_LOW = [1.0, -0.09]
ERBS_MID = [0.9511, -0.1604, 4.388, -16.638, 12.336]
ERBS_HIGH = 0.165
ERBS_LOW_LIMIT, ERBS_HIGH_LIMIT = 0.22, 0.80
CLEARNESS_MIN_COS = 0.065
BEAM_MAX_ZENITH = 87.0


def _fourier(angle: Column, series: tuple[float, list[tuple[float, float]]]) -> Column:
    mean, harmonics = series
    out = F.lit(mean)
    for k, (c, s) in enumerate(harmonics, start=1):
        out = out + F.lit(c) * F.cos(angle * F.lit(float(k))) + F.lit(s) * F.sin(angle * F.lit(float(k)))
    return out


def year_angle(doy) -> Column:
    return F.lit(2.0 * math.pi) * (col(doy) - F.lit(1.0)) / F.lit(365.0)


def solar_noon_utc(lon, doy) -> Column:
    """Hour (UTC) of local solar noon."""
    return noon_at(lon, year_angle(doy))


def noon_at(lon, angle) -> Column:
    minutes = F.lit(EOT_MINUTES) * _fourier(col(angle), EQUATION_OF_TIME)
    return F.lit(12.0) - col(lon) / F.lit(15.0) - minutes / F.lit(60.0)


def declination(angle) -> Column:
    return _fourier(col(angle), DECLINATION)


def extraterrestrial(angle) -> Column:
    """Irradiance above the atmosphere on a plane that faces the sun, W/m2."""
    return F.lit(EXTRATERRESTRIAL) * _fourier(col(angle), DISTANCE)


def cos_zenith(lat, decl, hours, noon) -> Column:
    """Cosine of the zenith angle, zero below the horizon."""
    phi, hour_angle = F.radians(col(lat)), F.radians((col(hours) - col(noon)) * F.lit(15.0))
    return clip(F.sin(phi) * F.sin(col(decl)) + F.cos(phi) * F.cos(col(decl)) * F.cos(hour_angle), 0.0, 1.0)


def clearness(ghi, top, cosz) -> Column:
    return F.least(col(ghi) / (col(top) * F.greatest(col(cosz), F.lit(CLEARNESS_MIN_COS))), F.lit(1.0))


def diffuse_share(kt) -> Column:
    k = col(kt)
    return (
        F.when(k <= ERBS_LOW_LIMIT, polynomial(k, ERBS_LOW))
        .when(k <= ERBS_HIGH_LIMIT, polynomial(k, ERBS_MID))
        .otherwise(F.lit(ERBS_HIGH))
    )


def low_sun(cosz) -> Column:
    """Sun too low for a beam."""
    return col(cosz) < F.lit(math.cos(math.radians(BEAM_MAX_ZENITH)))


def beam_normal(beam_horizontal, cosz) -> Column:
    return F.when(low_sun(cosz), F.lit(0.0)).otherwise(col(beam_horizontal) / F.greatest(col(cosz), F.lit(1e-6)))


def direct_fraction(beam_horizontal, ghi) -> Column:
    """Beam on the horizontal over global horizontal irradiance."""
    return F.when(col(ghi) > 1.0, F.least(col(beam_horizontal) / col(ghi), F.lit(1.0))).otherwise(F.lit(0.0))
