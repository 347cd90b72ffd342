"""Universal Thermal Climate Index: published regression polynomial.

The polynomial has total degree six in four variables -- air temperature,
10 m wind, radiant excess and vapour pressure. The weights are the published
ones (Broede et al. 2012), each listed with its four powers in
``utci_weights.txt`` next to this module; another file may be passed.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from heatgrid.functions.base import clip, col

# Fitted domain and vapour-pressure curve (kelvin): fixed values.
RADIANT_EXCESS = (-30.0, 70.0)
WIND_RANGE = (0.5, 17.0)
DEGREE = 6
VAPOUR_G = [-2836.5744, -6028.076559, 19.54263612, -0.02737830188, 0.000016261698, 7.0229056e-10, -1.8680009e-13]
VAPOUR_LOG = 2.7150305

WEIGHTS = Path(__file__).with_name("utci_weights.txt")


def exponents() -> list[tuple[int, int, int, int]]:
    """(air, wind, excess, vapour) powers with total degree <= 6, air fastest."""
    grid = product(range(DEGREE + 1), repeat=4)
    return [(a, w, d, v) for v, d, w, a in grid if a + w + d + v <= DEGREE]


@lru_cache(maxsize=4)
def load_weights(path: str = str(WEIGHTS)) -> tuple[float, ...]:
    """Weights in the order of :func:`exponents`; the file names the powers of each."""
    rows = [line.split() for line in Path(path).read_text().splitlines() if line.strip() and not line.startswith("#")]
    held = {tuple(int(x) for x in powers): float(weight) for *powers, weight in rows}
    if set(held) != set(exponents()) or len(rows) != len(held):
        raise ValueError(f"expected {len(exponents())} weights, one for each set of powers")
    return tuple(held[powers] for powers in exponents())


@lru_cache(maxsize=4)
def _cube(weights: tuple[float, ...]) -> np.ndarray:
    cube = np.zeros((DEGREE + 1,) * 4)
    for (a, w, d, v), value in zip(exponents(), weights):
        cube[v, d, w, a] = value
    return cube


def _evaluate(weights: tuple[float, ...], air, wind, excess, vapour) -> np.ndarray:
    """Nested Horner scheme over the four variables."""
    cube = _cube(weights)
    out = np.zeros_like(air)
    for v in range(DEGREE, -1, -1):
        per_v = np.zeros_like(air)
        for d in range(DEGREE - v, -1, -1):
            per_d = np.zeros_like(air)
            for w in range(DEGREE - v - d, -1, -1):
                per_w = np.zeros_like(air)
                for a in range(DEGREE - v - d - w, -1, -1):
                    per_w = per_w * air + cube[v, d, w, a]
                per_d = per_d * wind + per_w
            per_v = per_v * excess + per_d
        out = out * vapour + per_v
    return air + out


def vapour_pressure_hpa(t) -> Column:
    """Saturation vapour pressure used by the index, hPa (Hardy 1998)."""
    k = col(t) + F.lit(273.15)
    # log(1 + k), not log(k): the published check values are reproduced only with it.
    total = F.lit(VAPOUR_LOG) * F.log1p(k)
    for i, g in enumerate(VAPOUR_G):
        total = total + F.lit(g) * F.pow(k, F.lit(float(i - 2)))
    return F.exp(total) * F.lit(0.01)


def utci(t, radiant, wind10, rh, clip_inputs: bool = True, weights_path: str | None = None) -> Column:
    """UTCI in degC; ``wind10`` is the wind at 10 m."""
    weights = load_weights(weights_path or str(WEIGHTS))
    air, excess, wind = col(t), col(radiant) - col(t), col(wind10)
    if clip_inputs:
        excess, wind = clip(excess, *RADIANT_EXCESS), clip(wind, *WIND_RANGE)
    vapour = vapour_pressure_hpa(air) * clip(rh, 0.0, 100.0) / F.lit(100.0) / F.lit(10.0)

    @F.pandas_udf(DoubleType())
    def regress(a: pd.Series, w: pd.Series, d: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(_evaluate(weights, *(np.asarray(s, dtype=float) for s in (a, w, d, v))))

    return regress(air, wind, excess, vapour)
