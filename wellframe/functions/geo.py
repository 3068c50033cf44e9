"""Geodesy and trajectories as column expressions.

The spheroid's two problems iterate, and so are Arrow functions over whole batches: as nested lambdas they took seconds to
build and were interpreted row by row.  All else stays in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
# WGS 84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear; a zero-width bracket gives its left value."""
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0.0)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def distance_3d(horizontal: Column, dz: Column) -> Column:
    return F.hypot(horizontal, dz)


def _series(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The published method's B*A, B and C of cos^2 of the azimuth at the equator."""
    u = q * (A * A - B * B) / (B * B)
    return B * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))), FLATTENING / 16 * q * (4 + FLATTENING * (4 - 3 * q))


def _turn(b: np.ndarray, s: np.ndarray, c: np.ndarray, m: np.ndarray) -> np.ndarray:
    return b * s * (m + b / 4 * (c * (2 * m * m - 1) - b / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))


def _direct(lat: np.ndarray, lon: np.ndarray, azimuth_deg: np.ndarray, distance_m: np.ndarray, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Vincenty's direct problem by a fixed number of steps, each of which cuts the error some 300-fold."""
    z, tan_u = np.radians(azimuth_deg), (1 - FLATTENING) * np.tan(np.radians(lat))
    cos_u = 1 / np.sqrt(1 + tan_u * tan_u)
    sin_u, s1, sa = tan_u * cos_u, np.arctan2(tan_u, np.cos(z)), cos_u * np.sin(z)
    ba, bb, g = _series(1 - sa * sa)
    s = distance_m / ba
    for _ in range(steps):
        s = distance_m / ba + _turn(bb, np.sin(s), np.cos(s), np.cos(2 * s1 + s))
    sin, cos, m = np.sin(s), np.cos(s), np.cos(2 * s1 + s)
    lat2 = np.arctan2(sin_u * cos + cos_u * sin * np.cos(z), (1 - FLATTENING) * np.hypot(sa, sin_u * sin - cos_u * cos * np.cos(z)))
    lam = np.arctan2(sin * np.sin(z), cos_u * cos - sin_u * sin * np.cos(z))
    return np.degrees(lat2), lon + np.degrees(lam - (1 - g) * FLATTENING * sa * (s + g * sin * (m + g * cos * (2 * m * m - 1))))


def _inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, steps: int = 8) -> np.ndarray:
    """Vincenty's inverse problem by ``steps`` steps, or fewer if a step changes nothing that a double holds."""
    (s1, c1), (s2, c2) = ((t * c, c) for t in ((1 - FLATTENING) * np.tan(np.radians(x)) for x in (lat1, lat2)) for c in (1 / np.sqrt(1 + t * t),))
    l = np.radians(lon2 - lon1)
    ss_, cc, sc, cs_ = s1 * s2, c1 * c2, s1 * c2, c1 * s2
    lam, last = l, steps == 0
    for left in reversed(range(steps + 1)):
        sin, cos = np.sin(lam), np.cos(lam)
        x, y = c2 * sin, cs_ - sc * cos
        ss, cs = np.sqrt(x * x + y * y), ss_ + cc * cos
        sa = cc * sin / np.where(ss == 0, 1.0, ss)  # one point: 0 / 1
        q = 1 - sa * sa
        m = np.where(q == 0, 0.0, cs - 2 * ss_ / np.where(q == 0, 1.0, q))
        if last or not left:
            break
        g = FLATTENING / 16 * q * (4 + FLATTENING * (4 - 3 * q))
        old, lam = lam, l + (1 - g) * FLATTENING * sa * (np.arctan2(ss, cs) + g * ss * (m + g * cs * (2 * m * m - 1)))
        last = not np.nanmax(np.abs(lam - old), initial=0.0) > 1e-14
    ba, bb, _ = _series(q)
    return ba * (np.arctan2(ss, cs) - _turn(bb, ss, cs, m))


def spheroid_m(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """``geodesic_m`` for functions that have arrays already."""
    return _inverse(lat1, lon1, lat2, lon2)


def _numbers(*columns: pd.Series) -> list[np.ndarray]:
    """Nulls become NaN, and NaN results null again."""
    return [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]


def _place(lat: np.ndarray, lon: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lat": lat, "lon": lon})


def _project(lat: pd.Series, lon: pd.Series, azimuth_deg: pd.Series, distance_m: pd.Series) -> pd.DataFrame:
    return _place(*_direct(*_numbers(lat, lon, azimuth_deg, distance_m)))


def _geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(_inverse(*_numbers(lat1, lon1, lat2, lon2)))


def _offset(lat: pd.Series, lon: pd.Series, north_m: pd.Series, east_m: pd.Series) -> pd.DataFrame:
    lat_, lon_, north, east = _numbers(lat, lon, north_m, east_m)
    up = _direct(lat_, lon_, np.where(north >= 0, 0.0, 180.0), np.abs(north))
    return _place(*_direct(*up, np.where(east >= 0, 90.0, 270.0), np.abs(east)))


PLACE = "lat double, lon double"


def project(lat: Column, lon: Column, azimuth_deg: Column, distance_m: Column) -> Column:
    """struct(lat, lon) of the point at a bearing and distance on WGS 84; its fields are null where an input is."""
    return F.pandas_udf(_project, PLACE)(lat, lon, azimuth_deg, distance_m)


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on WGS 84 (0 for one point, null where an input is null; not for antipodes)."""
    return F.pandas_udf(_geodesic, "double")(lat1, lon1, lat2, lon2)


def offset_position(lat: Column, lon: Column, north_m: Column, east_m: Column) -> Column:
    """struct(lat, lon) after moving north, then east."""
    return F.pandas_udf(_offset, PLACE)(lat, lon, north_m, east_m)


def dogleg_rad(inc0: Column, azi0: Column, inc1: Column, azi1: Column) -> Column:
    """Angle between two survey directions in degrees of inclination and azimuth."""
    i0, i1, da = F.radians(inc0), F.radians(inc1), F.radians(azi1 - azi0)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(i1 - i0) - F.sin(i0) * F.sin(i1) * (1 - F.cos(da)))))


def ratio_factor(dogleg: Column) -> Column:
    """Minimum curvature's factor; 1 for a straight segment."""
    return F.when(dogleg < 1e-6, 1.0).otherwise(2 / dogleg * F.tan(dogleg / 2))


def metres_per_degree(lat_deg: float) -> tuple[float, float]:
    """Planar metres for one degree of latitude and of longitude."""
    return math.pi * EARTH_RADIUS_M / 180, math.pi * EARTH_RADIUS_M / 180 * math.cos(math.radians(lat_deg))
