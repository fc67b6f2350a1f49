"""Distances and boxes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EARTH_RADIUS_M = 6_371_000.0
CITY_LOOP_BOX = {"lat_min": -37.815, "lat_max": -37.808, "lon_min": 144.962, "lon_max": 144.975}
KM_PER_DEGREE_LAT = 111.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_M)


def in_box(lat: Column, lon: Column, box: dict[str, float] = CITY_LOOP_BOX) -> Column:
    """Inclusive containment; null when a coordinate is missing."""
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"])


def loop_contained(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Both ends of an episode inside the box; a missing end counts as outside."""
    return F.coalesce(in_box(lat1, lon1) & in_box(lat2, lon2), F.lit(False))


def grid_cell(lat: Column, lon: Column, size_deg: float) -> tuple[Column, Column]:
    return F.floor(lat / size_deg).cast("bigint"), F.floor(lon / size_deg).cast("bigint")


def degrees_for(metres: float, max_abs_lat: float = 60.0) -> float:
    """A cell edge wide enough that a radius reaches at most the neighbouring cell.

    Valid up to the given latitude: one degree of longitude there is the shortest span.
    """
    metres_per_degree = EARTH_RADIUS_M * math.pi / 180 * math.cos(math.radians(max_abs_lat))
    return metres / metres_per_degree
