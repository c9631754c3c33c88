"""Geographic column functions: grid conversion and great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grid_to_lat(northing) -> Column:
    """C19 (latitude): flat approximation from national-grid northing (m)."""
    n = _c(northing).cast('double')
    return F.lit(lx.GRID_ORIGIN_LAT) + (n - F.lit(lx.GRID_FALSE_NORTHING)) / F.lit(lx.KM_PER_DEGREE_M)


def grid_to_lon(easting, northing) -> Column:
    """C19 (longitude): scaled by cos(latitude); null in -> null out.

    Computed row-wise from the row's own easting/northing.
    """
    e = _c(easting).cast('double')
    lat = grid_to_lat(northing)
    return (F.lit(lx.GRID_ORIGIN_LON)
            + (e - F.lit(lx.GRID_FALSE_EASTING)) / (F.lit(lx.KM_PER_DEGREE_M) * F.cos(F.radians(lat))))


def great_circle_km(lat1, lon1, lat2, lon2, radius_km: float = lx.GREAT_CIRCLE_RADIUS_KM) -> Column:
    """C20: great-circle distance (atan2 form of the spherical law), km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    y = F.sqrt(F.pow(F.cos(p2) * F.sin(dl), 2)
               + F.pow(F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl), 2))
    x = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(dl)
    return F.lit(radius_km) * F.atan2(y, x)


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = lx.HAVERSINE_RADIUS_KM) -> Column:
    """Haversine distance, km (argument clamped to 1)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp = p2 - p1
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


DISTANCES = {
    'great_circle': (great_circle_km, lx.GREAT_CIRCLE_RADIUS_KM),
    'haversine': (haversine_km, lx.HAVERSINE_RADIUS_KM),
}


def distance_fn(kind: str):
    """Return (column function, earth radius) for 'great_circle' or 'haversine'."""
    try:
        return DISTANCES[kind]
    except KeyError as exc:  # pragma: no cover - argument check
        raise ValueError(f"unknown distance {kind!r}; use one of {sorted(DISTANCES)}") from exc
