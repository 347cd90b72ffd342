"""Implicit heat balances solved inside Arrow batches.

Globe and natural-wet-bulb temperature have no closed form. Both are damped
fixed points; each row stops by its own step size, so a result never depends
on which rows happen to share a batch. Everything that does not change from
step to step is computed once in Spark columns and passed in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from heatgrid.functions.base import at_least, col
from heatgrid.functions.psychro import BUCK_A, BUCK_B, BUCK_C, BUCK_D
from heatgrid.functions.radiation import (
    GLOBE_DIAMETER_M,
    GLOBE_EMISSIVITY,
    KELVIN,
    STEFAN_BOLTZMANN,
    SURFACE_EMISSIVITY,
)

# Air and water constants and solver settings: fixed values.
M_AIR = 28.97
R_AIR = 8314.34 / M_AIR
CP_AIR = 1003.5
WICK_DIAMETER_M = 0.007
WICK_EMISSIVITY = 0.95
MAX_STEPS = 50
TOLERANCE = 0.02
CALM_FLOOR = 0.13


def _air(film_k: np.ndarray, p_kpa: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Density, viscosity and conductivity at the film temperature."""
    rho = p_kpa * 1000.0 / (R_AIR * film_k)
    mu = 1.458e-6 * film_k**1.5 / (film_k + 110.4)
    k = 0.02624 * (film_k / 300.0) ** 0.8646
    return rho, mu, k


def _fixed_point(start: np.ndarray, step, *inputs: np.ndarray) -> np.ndarray:
    """Iterate ``step`` per row until that row moves less than the tolerance."""
    out = start.copy()
    live = np.flatnonzero(np.isfinite(start) & np.all([np.isfinite(a) for a in inputs], axis=0))
    out[np.setdiff1d(np.arange(len(out)), live)] = np.nan
    args = [a[live] for a in inputs]
    x = out[live]
    for _ in range(MAX_STEPS):
        if not len(live):
            break
        nxt = step(x, *args)
        moving = np.abs(nxt - x) >= TOLERANCE
        out[live] = nxt
        live, x, args = live[moving], nxt[moving], [a[moving] for a in args]
    return out


def _globe_step(tg, ta, wind, p, shortwave, emis):
    film = (ta + tg) / 2.0
    rho, mu, k = _air(film, p)
    prandtl = CP_AIR * mu / k
    reynolds = np.maximum(rho * wind * GLOBE_DIAMETER_M / mu, 1e-3)
    forced = 2.0 + 0.6 * np.sqrt(reynolds) * np.cbrt(prandtl)
    grashof = (
        9.81 / np.maximum(film, 1.0) * np.abs(tg - ta) * GLOBE_DIAMETER_M**3 / np.maximum((mu / rho) ** 2, 1e-12)
    )
    free = 2.0 + 0.589 * (grashof * prandtl) ** 0.25 / (1.0 + (0.469 / prandtl) ** (9 / 16)) ** (4 / 9)
    h = np.maximum(np.cbrt(forced**3 + free**3) * k / GLOBE_DIAMETER_M, 1e-6)
    longwave = 0.5 * (emis + SURFACE_EMISSIVITY) * ta**4 - tg**4
    target = ta + (shortwave + GLOBE_EMISSIVITY * STEFAN_BOLTZMANN * longwave) / h
    return tg + 0.5 * (target - tg)


def _wick_step(tw, ta_c, td, wind, p, shortwave, emis, e_air):
    tw_k, ta = tw + KELVIN, ta_c + KELVIN
    film = (ta + tw_k) / 2.0
    rho, mu, k = _air(film, p)
    diffusivity = 2.471e-5 * (film / 298.0) ** 1.75 / (p / 101.325)
    latent = (2.501 - 0.00237 * (tw_k - KELVIN)) * 1e6
    flow = 0.281 * np.maximum(rho * wind * WICK_DIAMETER_M / mu, 1e-3) ** 0.6
    h = flow * (CP_AIR * mu / k) ** 0.44 * k / WICK_DIAMETER_M
    h_mass = flow * (mu / (rho * diffusivity)) ** 0.44 * diffusivity / WICK_DIAMETER_M
    e_wick = BUCK_A * np.exp((BUCK_B - tw / BUCK_C) * (tw / (BUCK_D + tw)))
    vapour = h_mass * rho * 0.622 * (e_wick - e_air) / np.maximum(p, 1e-6)
    longwave = 0.5 * (emis + SURFACE_EMISSIVITY) * ta**4 - tw_k**4
    gain = shortwave + WICK_EMISSIVITY * STEFAN_BOLTZMANN * longwave
    target = np.clip(ta_c + (gain - latent * vapour) / np.maximum(h, 1e-6), td - 1.0, ta_c + 4.0)
    return tw + 0.4 * (target - tw)


@F.pandas_udf(DoubleType())
def _solve_globe(ta: pd.Series, wind: pd.Series, p: pd.Series, sw: pd.Series, emis: pd.Series) -> pd.Series:
    a = [np.asarray(s, dtype=float) for s in (ta, wind, p, sw, emis)]
    kelvin = a[0] + KELVIN
    return pd.Series(_fixed_point(kelvin, _globe_step, kelvin, *a[1:]) - KELVIN)


@F.pandas_udf(DoubleType())
def _solve_wick(
    ta: pd.Series, td: pd.Series, wind: pd.Series, p: pd.Series, sw: pd.Series, emis: pd.Series, e: pd.Series
) -> pd.Series:
    a = [np.asarray(s, dtype=float) for s in (ta, td, wind, p, sw, emis, e)]
    return pd.Series(_fixed_point(a[0], _wick_step, *a))


def globe_temperature(t, wind, pressure, shortwave, emissivity) -> Column:
    """Temperature of a 150 mm black globe, degC."""
    return _solve_globe(col(t), at_least(wind, CALM_FLOOR), col(pressure), col(shortwave), col(emissivity))


def natural_wet_bulb(t, dewpoint, wind, pressure, shortwave, emissivity, vapour) -> Column:
    """Temperature of a wetted wick in sun and wind, degC."""
    return _solve_wick(
        col(t), col(dewpoint), at_least(wind, CALM_FLOOR), col(pressure), col(shortwave), col(emissivity), col(vapour)
    )
