"""Polar stereographic projection, blocking cells, longitude helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# WGS84 ellipsoid; latitude of true scale and central meridian per projection.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
POLAR = {"EPSG:3031": (-71.0, 0.0), "EPSG:3413": (70.0, -45.0)}

_E2 = 2 * WGS84_F - WGS84_F**2
_E = math.sqrt(_E2)


def _constants(crs: str) -> tuple[float, float, float]:
    """(hemisphere sign, central meridian in radians, radius per unit of t)."""
    lat_ts, lon0 = POLAR[crs]
    phi = math.radians(abs(lat_ts))
    es = _E * math.sin(phi)
    t_ts = math.tan(math.pi / 4 - phi / 2) * ((1 + es) / (1 - es)) ** (_E / 2)
    m_ts = math.cos(phi) / math.sqrt(1 - es * es)
    return (1.0 if lat_ts > 0 else -1.0), math.radians(lon0), WGS84_A * m_ts / t_ts


def project(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """Degrees to metres in ``crs``; NULL in, NULL out.  EPSG:4326 passes through."""
    if crs == "EPSG:4326":
        return lon, lat
    sign, lon0, scale = _constants(crs)
    phi = F.radians(lat) * F.lit(sign)
    dlon = F.radians(lon) - F.lit(lon0)
    es = F.sin(phi) * F.lit(_E)
    rho = F.lit(scale) * F.tan(F.lit(math.pi / 4) - phi / 2) * F.pow((1 + es) / (1 - es), F.lit(_E / 2))
    return rho * F.sin(dlon), rho * F.cos(dlon) * F.lit(-sign)


def unproject(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """Metres in ``crs`` back to degrees: latitude series plus one fixed-point step."""
    if crs == "EPSG:4326":
        return x, y
    sign, lon0, scale = _constants(crs)
    t = F.hypot(x, y) / F.lit(scale)
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    e4, e6, e8 = _E2**2, _E2**3, _E2**4
    phi = (
        chi
        + F.lit(_E2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi)
        + F.lit(7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        + F.lit(7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi)
        + F.lit(4279 * e8 / 161280) * F.sin(8 * chi)
    )
    es = F.sin(phi) * F.lit(_E)
    phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - es) / (1 + es), F.lit(_E / 2)))
    lon = F.degrees(F.lit(lon0) + F.atan2(x, y * F.lit(-sign)))
    return wrap_longitude(lon), F.degrees(phi) * F.lit(sign)


def project_by_sheet(lon: Column, lat: Column, sheet: Column, crs_of: dict[str, str]) -> tuple[Column, Column]:
    """Each row projected in the system of its own sheet."""
    px = py = None
    for name, crs in crs_of.items():
        x, y = project(lon, lat, crs)
        hit = sheet == F.lit(name)
        px = F.when(hit, x) if px is None else px.when(hit, x)
        py = F.when(hit, y) if py is None else py.when(hit, y)
    return px, py


def wrap_longitude(lon: Column) -> Column:
    """Any longitude to [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def close_antimeridian(field: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Repeat the x = -180 column at x = +180 on every row (of one y) that is not there yet, so doing it again changes nothing."""
    closed = field.where(F.col(x) >= 180.0).select(y)
    copies = field.where(F.col(x) == -180.0).withColumn(x, F.lit(180.0)).join(closed, y, "left_anti")
    return field.unionByName(copies)


def unproject_by_sheet(x: Column, y: Column, sheet: Column, crs_of: dict[str, str]) -> tuple[Column, Column]:
    """Each row back to degrees from the system of its own sheet."""
    lon = lat = None
    for name, crs in crs_of.items():
        a, b = unproject(x, y, crs)
        hit = sheet == F.lit(name)
        lon = F.when(hit, a) if lon is None else lon.when(hit, a)
        lat = F.when(hit, b) if lat is None else lat.when(hit, b)
    return lon, lat


def cell_id(x: Column, y: Column, sheet: Column, size_m: float, codes: dict[str, str]) -> Column:
    """``code:i:j`` with i, j the floored cell indices anchored at (0, 0)."""
    code = None
    for name, short in codes.items():
        code = F.when(sheet == name, F.lit(short)) if code is None else code.when(sheet == name, F.lit(short))
    i = F.floor(x / F.lit(float(size_m))).cast("string")
    j = F.floor(y / F.lit(float(size_m))).cast("string")
    return F.concat(code, F.lit(":"), i, F.lit(":"), j)
