"""Geodesic column functions (native expressions, no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres used by the reference distances.
EARTH_R_M = 6371000.0
# Metres per degree of latitude on that sphere.
M_PER_DEG = EARTH_R_M * math.pi / 180.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres, atan2 form, inputs in degrees."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = F.radians(_c(lat2) - _c(lat1))
    dlmb = F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_R_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def angular_to_m(c) -> Column:
    """Angular distance in radians -> metres."""
    return _c(c) * F.lit(EARTH_R_M)
