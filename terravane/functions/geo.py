"""Points on the sphere: cells, distances and predicates as Columns.

Coordinates are named latitude and longitude columns in degrees everywhere; distances are kilometres on a sphere of radius
6378 km. A null coordinate gives a null cell or distance, and such a row passes no predicate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: radius of the sphere in km.
EARTH_KM = 6378.0


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Box:
    """A bounding box; all four sides are exclusive."""

    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float

    def contains(self, lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
        lat, lon = _col(lat), _col(lon)
        return (lat > self.min_lat) & (lat < self.max_lat) & (lon > self.min_lon) & (lon < self.max_lon)


def area_cell(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    """The 0.001 degree cell of a point as one long: both parts are cut towards zero."""
    return (_col(lat) * 1000).cast("long") + (_col(lon) * 1000).cast("long") * F.lit(10_000_000).cast("long")


def cos_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Cosine of the central angle between two points; right in both hemispheres."""
    a, b = F.radians(lat1), F.radians(lat2)
    return F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; rounding beyond a cosine of 1 or -1 is cut off."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_angle(lat1, lon1, lat2, lon2)))) * EARTH_KM


def within_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: Column | float) -> Column:
    """Strictly nearer than the radius. Cosines are compared, so there is no arc cosine for each pair."""
    radius = F.lit(float(radius_km)) if isinstance(radius_km, (int, float)) else radius_km
    return cos_angle(lat1, lon1, lat2, lon2) > F.cos(radius / EARTH_KM)


def in_square(lat: Column, lon: Column, center_lat: Column, center_lon: Column, half_side: float) -> Column:
    """Inside or on the square of the given half side in degrees."""
    return lat.between(center_lat - half_side, center_lat + half_side) & lon.between(center_lon - half_side, center_lon + half_side)


def margin_deg(radius_km: float) -> float:
    """Degrees of latitude that a circle of this radius reaches, with two per cent to spare."""
    return radius_km / (EARTH_KM * math.pi / 180) * 1.02
