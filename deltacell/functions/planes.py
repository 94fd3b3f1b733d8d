"""The conversions of ``crs`` for arrays inside tasks: 4326, UTM 326xx/327xx, 3857, 6933.

Used where a CRS is a column: an expression that chains two of the series would be far larger than the
plan around it, and arrays of one grid at a time are faster.
"""

from __future__ import annotations

import math

import numpy as np

from deltacell.functions import crs as C

Arrays = tuple[np.ndarray, np.ndarray]


def _zone(epsg: int) -> bool:
    return 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760


def _utm_constants(epsg: int) -> tuple[float, float, float]:
    return epsg % 100 * 6.0 - 183.0, 1.0e7 if epsg >= 32700 else 0.0, C._SCALE * C._RADIUS


def _authalic(phi: np.ndarray) -> np.ndarray:
    s = np.sin(phi)
    return (1 - C.E2) * (s / (1 - C.E2 * s * s) - np.log((1 - C.ECC * s) / (1 + C.ECC * s)) / (2 * C.ECC))


def to_lonlat(x: np.ndarray, y: np.ndarray, epsg: int) -> Arrays:
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return np.degrees(x / C.A), np.degrees(2 * np.arctan(np.exp(y / C.A)) - math.pi / 2)
    if epsg == 6933:
        q = np.clip(2 * y * C._EASE_K / C.A, -C._Q_POLE, C._Q_POLE)
        phi = np.arcsin(q / C._Q_POLE)
        for _ in range(8):
            sin2 = 1 - C.E2 * np.sin(phi) ** 2
            phi = phi + (q - _authalic(phi)) * sin2 * sin2 / (2 * (1 - C.E2) * np.maximum(np.cos(phi), 1e-12))
        return np.degrees(x / (C.A * C._EASE_K)), np.degrees(np.clip(phi, -math.pi / 2, math.pi / 2))
    if _zone(epsg):
        meridian, shift, scale = _utm_constants(epsg)
        xi, eta = (y - shift) / scale, (x - 500000.0) / scale
        xi0, eta0 = xi.copy(), eta.copy()
        for j, c in enumerate(C._INVERSE, 1):
            xi0 -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            eta0 -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        phi = conformal = np.arcsin(np.sin(xi0) / np.cosh(eta0))
        psi = np.arctanh(np.sin(conformal))
        for _ in range(5):
            phi = np.arctan(np.sinh(psi + C.ECC * np.arctanh(C.ECC * np.sin(phi))))
        return meridian + np.degrees(np.arctan2(np.sinh(eta0), np.cos(xi0))), np.degrees(phi)
    raise ValueError(f"unsupported EPSG code: {epsg}")


def from_lonlat(lon: np.ndarray, lat: np.ndarray, epsg: int) -> Arrays:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return C.A * np.radians(lon), C.A * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))
    if epsg == 6933:
        return C.A * C._EASE_K * np.radians(lon), C.A * _authalic(np.radians(lat)) / (2 * C._EASE_K)
    if _zone(epsg):
        meridian, shift, scale = _utm_constants(epsg)
        phi, lam = np.radians(lat), np.radians(lon - meridian)
        t = np.sinh(np.arctanh(np.sin(phi)) - C.ECC * np.arctanh(C.ECC * np.sin(phi)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.sqrt(t * t + np.cos(lam) ** 2))
        north, east = xi.copy(), eta.copy()
        for j, c in enumerate(C._FORWARD, 1):
            north += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            east += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        return 500000.0 + scale * east, shift + scale * north
    raise ValueError(f"unsupported EPSG code: {epsg}")


def reproject(x: np.ndarray, y: np.ndarray, source: int, target: int) -> Arrays:
    """Points in another CRS; places that one of the two cannot show come out as not finite."""
    if source == target:
        return x, y
    with np.errstate(all="ignore"):
        return from_lonlat(*to_lonlat(x, y, source), target)


def place(gt, row: np.ndarray, col: np.ndarray) -> Arrays:
    """Coordinates of real row and column positions; a cell spans from its index to the next."""
    return gt[0] + col * gt[1] + row * gt[2], gt[3] + col * gt[4] + row * gt[5]


def position(gt, x: np.ndarray, y: np.ndarray) -> Arrays:
    """Real row and column of points."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = x - gt[0], y - gt[3]
    return (gt[1] * dy - gt[4] * dx) / det, (gt[5] * dx - gt[2] * dy) / det


def between(row: np.ndarray, col: np.ndarray, gt, epsg: int, to_gt, to_epsg: int) -> Arrays:
    """Positions of one grid as positions of another."""
    return position(to_gt, *reproject(*place(gt, row, col), epsg, to_epsg))
