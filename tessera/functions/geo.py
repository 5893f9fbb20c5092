"""Distances and containment of points. A point is a struct of lon and lat in degrees."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

EARTH_RADIUS = 6371e3

#: Metres of each unit.
METRES = {"cm": 0.01, "m": 1.0, "km": 1000.0, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}

#: The WGS-84 ellipsoid.
WGS84_MAJOR, WGS84_FLATTENING = 6378137.0, 1 / 298.257223563

Point = dict[str, float]


def metres(value: float, unit: str = "m") -> float:
    if unit not in METRES:
        raise EngineError("INVALID_DISTANCE_SUFFIX", unit)
    return value * METRES[unit]


def haversine(lon: Column, lat: Column, centre: Point) -> Column:
    """Great-circle distance in metres."""
    lat0, lon0 = math.radians(centre["lat"]), math.radians(centre["lon"])
    dlat, dlon = F.radians(lat) - lat0, F.radians(lon) - lon0
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.lit(math.cos(lat0)) * F.cos(F.radians(lat)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def vincenty_metres(lon: np.ndarray, lat: np.ndarray, centre: Point) -> np.ndarray:
    """Distances on the ellipsoid by Vincenty's inverse formula; 0 for the same point, NaN without convergence."""
    f, a = WGS84_FLATTENING, WGS84_MAJOR
    b = a * (1 - f)
    lon, lat = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    u1, u2 = np.arctan((1 - f) * np.tan(math.radians(centre["lat"]))), np.arctan((1 - f) * np.tan(lat))
    gap = lon - math.radians(centre["lon"])
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = gap.copy()
    out = np.full(lam.shape, np.nan)
    open_ = ~np.isnan(lam) & ~np.isnan(lat)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(1000):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((cu2 * sl) ** 2 + (cu1 * su2 - su1 * cu2 * cl) ** 2)
            same = open_ & (ss == 0)
            out[same] = 0.0
            open_ &= ~same
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = cu1 * cu2 * sl / ss
            ca2 = 1 - sa**2
            c2m = np.where(ca2 == 0, 0.0, cs - 2 * su1 * su2 / ca2)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = gap + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (-1 + 2 * c2m**2)))
            done = open_ & (np.abs(new - lam) <= 1e-12)
            if done.any():
                k = ca2 * (a**2 - b**2) / b**2
                big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
                big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
                ds = big_b * ss * (c2m + big_b / 4 * (cs * (-1 + 2 * c2m**2) - big_b / 6 * c2m * (-3 + 4 * ss**2) * (-3 + 4 * c2m**2)))
                out[done] = (b * big_a * (sigma - ds))[done]
                open_ &= ~done
            if not open_.any():
                break
            lam = np.where(open_, new, lam)
    return out


def vincenty(lon: Column, lat: Column, centre: Point) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(vincenty_metres(x.to_numpy(float), y.to_numpy(float), centre))

    return run(lon, lat)


def distance(lon: Column, lat: Column, centre: Point, high_precision: bool = False) -> Column:
    return vincenty(lon, lat, centre) if high_precision else haversine(lon, lat, centre)


def in_polygon(lon: Column, lat: Column, polygon: list[Point]) -> Column:
    """Even-odd rule. Edges along a parallel never count; the others are unrolled into one expression."""
    crossings = []
    for a, b in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if a["lat"] != b["lat"]:
            slope = (b["lon"] - a["lon"]) / (b["lat"] - a["lat"])
            spans = (F.lit(a["lat"]) > lat) != (F.lit(b["lat"]) > lat)
            crossings.append(F.when(spans & (lon < F.lit(slope) * (lat - a["lat"]) + a["lon"]), 1).otherwise(0))
    return (reduce(lambda x, y: x + y, crossings, F.lit(0)) % 2) == 1


def centroid(polygon: list[Point]) -> Point:
    """The area-weighted centre of a polygon; the mean of its corners if it has no area."""
    area = x = y = 0.0
    for a, b in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        cross = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        area += cross
        x += (a["lon"] + b["lon"]) * cross
        y += (a["lat"] + b["lat"]) * cross
    if area == 0:
        n = len(polygon)
        return {"lon": sum(p["lon"] for p in polygon) / n, "lat": sum(p["lat"] for p in polygon) / n}
    return {"lon": x / (3 * area), "lat": y / (3 * area)}
