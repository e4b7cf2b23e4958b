"""Universal Transverse Mercator on the WGS 84 ellipsoid, as column expressions (Krueger series)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and UTM.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING = 0.9996, 500000.0

_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168,
    34729 * _N**5 / 80640,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504,
    4583 * _N**5 / 161280,
)


def central_meridian(zone: int) -> float:
    return 6.0 * zone - 183.0


def to_utm(lon: Column, lat: Column, zone: int = 31) -> tuple[Column, Column]:
    """Easting and northing of a northern zone."""
    phi, lam = F.radians(lat), F.radians(lon - central_meridian(zone))
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y


def to_lonlat(easting: Column, northing: Column, zone: int = 31, steps: int = 5) -> tuple[Column, Column]:
    """Longitude and latitude; the latitude is refined ``steps`` times."""
    xi0, eta0 = northing / (SCALE * RADIUS), (easting - FALSE_EASTING) / (SCALE * RADIUS)
    xi, eta = xi0, eta0
    for k, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0)
        eta = eta - b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0)
    target = F.asinh(F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi)))
    psi = target
    for _ in range(steps):
        psi = target + ECCENTRICITY * F.atanh(ECCENTRICITY * F.tanh(psi))
    return central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(F.atan(F.sinh(psi)))
