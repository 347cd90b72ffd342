"""Distance and coastline columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import col
from heatgrid.functions.scaling import interp

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0
LON_SCALE = math.cos(math.radians(20.5))

#: (longitude, latitude) of the approximate coastline, west to east: fixed values.
COASTLINE = [
    (84.40, 18.70),
    (84.91, 19.26),
    (85.45, 19.62),
    (85.83, 19.80),
    (86.10, 19.88),
    (86.67, 20.26),
    (86.95, 20.75),
    (87.03, 21.45),
    (87.47, 21.60),
    (87.80, 21.65),
]
COAST_SLACK = 0.02


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    dlat = F.radians(col(lat2) - col(lat1)) / F.lit(2.0)
    dlon = F.radians(col(lon2) - col(lon1)) / F.lit(2.0)
    a = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * F.pow(
        F.sin(dlon), F.lit(2.0)
    )
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar_degrees(lat1, lon1, lat2, lon2, lon_scale: float = LON_SCALE) -> Column:
    dx = (col(lon2) - col(lon1)) * F.lit(lon_scale)
    dy = col(lat2) - col(lat1)
    return F.sqrt(dx * dx + dy * dy)


def coast_latitude(lon) -> Column:
    x = col(lon)
    return F.when(x < COASTLINE[0][0], F.lit(-90.0)).otherwise(interp(x, COASTLINE))


def is_sea(lat, lon) -> Column:
    return col(lat) < coast_latitude(lon) - F.lit(COAST_SLACK)


def square_ring(lat, lon, resolution: float = 0.25) -> Column:
    """Closed [lon, lat] ring of a grid cell around its centre."""
    h = F.lit(resolution / 2.0)
    y, x = col(lat), col(lon)
    west, east, south, north = x - h, x + h, y - h, y + h
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.array(*[F.array(cx, cy) for cx, cy in corners])


def _shoelace(ring: Column, term) -> Column:
    edges = F.arrays_zip(
        F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("q")
    )
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e["p"], e["q"]))


def ring_area_deg2(ring) -> Column:
    cross = _shoelace(col(ring), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(cross) / F.lit(2.0)


def ring_centroid(ring) -> Column:
    """struct(lon, lat) of a closed ring by the shoelace formula."""
    r = col(ring)
    cross = _shoelace(r, lambda p, q: p[0] * q[1] - q[0] * p[1])
    cx = _shoelace(r, lambda p, q: (p[0] + q[0]) * (p[0] * q[1] - q[0] * p[1]))
    cy = _shoelace(r, lambda p, q: (p[1] + q[1]) * (p[0] * q[1] - q[0] * p[1]))
    return F.struct((cx / (cross * F.lit(3.0))).alias("lon"), (cy / (cross * F.lit(3.0))).alias("lat"))


def ring_area_km2(ring, lat) -> Column:
    return ring_area_deg2(ring) * F.lit(KM_PER_DEGREE**2) * F.cos(F.radians(col(lat)))
