"""Closed-form coordinate conversions as Column expressions: 4326, UTM 326xx/327xx, 3857, 6933."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the transverse Mercator series built from it.
A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_SCALE = 0.9996
_EASE_LAT = math.radians(30.0)
_EASE_K = math.cos(_EASE_LAT) / math.sqrt(1 - E2 * math.sin(_EASE_LAT) ** 2)
_Q_POLE = 1 - (1 - E2) / (2 * ECC) * math.log((1 - ECC) / (1 + ECC))

Pair = tuple[Column, Column]


def utm_epsg(lon: Column, lat: Column | None = None) -> Column:
    """EPSG of the UTM zone of a longitude (northern by default, southern for negative ``lat``)."""
    base = F.lit(32600) if lat is None else F.when(lat < 0, 32700).otherwise(32600)
    return (base + F.floor((lon + 180) / 6) + 1).cast("int")


def _central_meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6.0 - 183.0


def _isometric(phi: Column) -> Column:
    return F.atanh(F.sin(phi)) - F.lit(ECC) * F.atanh(F.lit(ECC) * F.sin(phi))


def lonlat_to_utm(lon: Column, lat: Column, epsg: Column) -> Pair:
    lam = F.radians(lon - _central_meridian(epsg))
    t = F.sinh(_isometric(F.radians(lat)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for j, c in enumerate(_FORWARD, 1):
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    shift = F.when(epsg >= 32700, 1.0e7).otherwise(0.0)
    return F.lit(500000.0) + _SCALE * _RADIUS * east, shift + _SCALE * _RADIUS * north


def utm_to_lonlat(x: Column, y: Column, epsg: Column) -> Pair:
    shift = F.when(epsg >= 32700, 1.0e7).otherwise(0.0)
    xi = (y - shift) / (_SCALE * _RADIUS)
    eta = (x - 500000.0) / (_SCALE * _RADIUS)
    xi0, eta0 = xi, eta
    for j, c in enumerate(_INVERSE, 1):
        xi0 = xi0 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(xi0) / F.cosh(eta0))
    psi = F.atanh(F.sin(conformal))
    phi = conformal
    for _ in range(5):
        phi = F.atan(F.sinh(psi + F.lit(ECC) * F.atanh(F.lit(ECC) * F.sin(phi))))
    return _central_meridian(epsg) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(phi)


def lonlat_to_mercator(lon: Column, lat: Column) -> Pair:
    return A * F.radians(lon), A * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_to_lonlat(x: Column, y: Column) -> Pair:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


def _authalic(phi: Column) -> Column:
    s = F.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))


def lonlat_to_equal_area(lon: Column, lat: Column) -> Pair:
    """Cylindrical equal-area with standard parallel 30 degrees (EPSG:6933)."""
    return A * _EASE_K * F.radians(lon), A * _authalic(F.radians(lat)) / (2 * _EASE_K)


def equal_area_to_lonlat(x: Column, y: Column) -> Pair:
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * y * _EASE_K / (A * _Q_POLE))))
    e4, e6 = E2**2, E2**3
    phi = (
        beta
        + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    # The series alone is good to about a millimetre; one Newton step takes it below a micrometre.
    sin2 = 1 - E2 * F.sin(phi) * F.sin(phi)
    slope = 2 * (1 - E2) * F.greatest(F.cos(phi), F.lit(1e-12)) / (sin2 * sin2)
    phi = phi + (2 * y * _EASE_K / A - _authalic(phi)) / slope
    return F.degrees(x / (A * _EASE_K)), F.degrees(phi)


def to_lonlat(x: Column, y: Column, epsg: int) -> Pair:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return mercator_to_lonlat(x, y)
    if epsg == 6933:
        return equal_area_to_lonlat(x, y)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return utm_to_lonlat(x, y, F.lit(epsg))
    raise ValueError(f"unsupported EPSG code: {epsg}")


def from_lonlat(lon: Column, lat: Column, epsg: int) -> Pair:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return lonlat_to_mercator(lon, lat)
    if epsg == 6933:
        return lonlat_to_equal_area(lon, lat)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return lonlat_to_utm(lon, lat, F.lit(epsg))
    raise ValueError(f"unsupported EPSG code: {epsg}")


def reproject(x: Column, y: Column, source: int, target: int) -> Pair:
    if source == target:
        return x, y
    return from_lonlat(*to_lonlat(x, y, source), target)
