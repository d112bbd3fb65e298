"""Longitude and latitude to transverse Mercator zones and back, by the Krueger series to the fourth order.

The same formulas serve columns and numpy arrays; both ways are exact to a millimetre within some degrees of the
meridian. Nulls stay null.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and UTM.
A, FLAT, SCALE, EAST, MERIDIAN = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 15.0
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# The series of Krueger, to the plane, back, and from conformal to geographic latitude.
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280]
DELTA = [2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630]

ARRAYS = SimpleNamespace(sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, sqrt=np.sqrt, asin=np.arcsin, atan2=np.arctan2, atanh=np.arctanh, radians=np.radians, degrees=np.degrees)


def forward(lon, lat, meridian: float = MERIDIAN, m=F):
    """(easting, northing) in metres; m holds the functions: pyspark.sql.functions or ARRAYS."""
    k = 2 * math.sqrt(N) / (1 + N)
    phi, lam = m.radians(lat), m.radians(lon - meridian)
    sin = m.sin(phi)
    t = m.sinh(m.atanh(sin) - k * m.atanh(k * sin))
    xi = m.atan2(t, m.cos(lam))
    eta = m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return EAST + SCALE * RADIUS * x, SCALE * RADIUS * y


def inverse(x, y, meridian: float = MERIDIAN, m=F):
    """(longitude, latitude) in degrees of an easting and northing."""
    xi, eta = y / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    u, v = xi, eta
    for j, b in enumerate(BETA, 1):
        u = u - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        v = v - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(u) / m.cosh(v))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * m.sin(2 * j * chi)
    return meridian + m.degrees(m.atan2(m.sinh(v), m.cos(u))), m.degrees(phi)


def utm33(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in zone 33."""
    return forward(lon, lat)


def lonlat33(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of a place in zone 33."""
    return inverse(x, y)
