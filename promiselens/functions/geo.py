"""Great-circle distance and the coordinate box of the market."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371
SOUTH, NORTH, WEST, EAST = -33.8, 5.3, -74.0, -34.7


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lng1, lat2, lng2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def is_inside_market(lat="latitude", lng="longitude") -> Column:
    return F.col(lat).between(SOUTH, NORTH) & F.col(lng).between(WEST, EAST)
