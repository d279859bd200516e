"""Coordinates, distances and road attributes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371
COORDINATE_TOLERANCE = 0.0001
METRES_PER_DEGREE = 111000
MERGE_METRES_PER_DEGREE = 111111
ROAD_LEVELS = {
    "motorway": 1,
    "trunk": 2,
    "primary": 3,
    "secondary": 4,
    "tertiary": 5,
    "unclassified": 6,
    "residential": 7,
    "service": 8,
    "track": 9,
    "path": 10,
    "footway": 11,
    "cycleway": 12,
    "living_street": 7,
    "pedestrian": 11,
}
UNKNOWN_ROAD_LEVEL = 9
RESTRICTED_VALUES = ["private", "residents", "no", "destination"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def near_equal(lat1, lon1, lat2, lon2, tol: float = COORDINATE_TOLERANCE) -> Column:
    """Strict tolerance match on both axes."""
    return (F.abs(col(lat1) - col(lat2)) < tol) & (F.abs(col(lon1) - col(lon2)) < tol)


def in_box(lat, lon, center_lat, center_lon, half_width: float) -> Column:
    """Inclusive bounding box."""
    return col(lat).between(col(center_lat) - half_width, col(center_lat) + half_width) & col(lon).between(
        col(center_lon) - half_width, col(center_lon) + half_width
    )


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; a missing or non-numeric coordinate gives 0.0."""
    p1, l1, p2, l2 = (F.radians(col(c).try_cast("double")) for c in (lat1, lon1, lat2, lon2))
    return F.coalesce(_arc_km(p1, l1, p2, l2), F.lit(0.0))


def arc_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance for columns known to be doubles; null stays null."""
    return _arc_km(*(F.radians(col(c)) for c in (lat1, lon1, lat2, lon2)))


def _arc_km(p1: Column, l1: Column, p2: Column, l2: Column) -> Column:
    half_lat, half_lon = F.sin((p2 - p1) / 2), F.sin((l2 - l1) / 2)
    h = half_lat * half_lat + F.cos(p1) * F.cos(p2) * (half_lon * half_lon)
    within = F.when(h > 1, 1.0).otherwise(h)  # least() would turn a null into 1
    return F.asin(F.sqrt(within)) * (2 * EARTH_KM)


def degree_distance_sq(lat1, lon1, lat2, lon2) -> Column:
    dlat, dlon = col(lat1) - col(lat2), col(lon1) - col(lon2)
    return dlat * dlat + dlon * dlon


def degree_distance(lat1, lon1, lat2, lon2) -> Column:
    return F.sqrt(degree_distance_sq(lat1, lon1, lat2, lon2))


def metres_to_degrees(metres: float, per_degree: int = METRES_PER_DEGREE) -> float:
    return metres / per_degree


def int_metres(km) -> Column:
    """Integer cost: km to metres, cut off after the decimal point."""
    return (col(km) * 1000).cast("bigint")


def unit_xyz(lat, lon) -> list[Column]:
    """Position in km on a sphere of the earth's radius; straight distance there grows with the arc."""
    p, l = F.radians(col(lat)), F.radians(col(lon))
    return [F.cos(p) * F.cos(l) * EARTH_KM, F.cos(p) * F.sin(l) * EARTH_KM, F.sin(p) * EARTH_KM]


def chord_km(arc: float) -> float:
    """Straight distance that belongs to an arc length."""
    return 2 * EARTH_KM * math.sin(min(arc / (2 * EARTH_KM), math.pi / 2))


def coord_key(lat, lon, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f,%.{digits}f", col(lat), col(lon))


def leg_key(lat1, lon1, lat2, lon2) -> Column:
    return F.format_string("route:%.5f,%.5f:%.5f,%.5f", col(lat1), col(lon1), col(lat2), col(lon2))


def road_level(highway) -> Column:
    """Road class as a number, 1 the most important; a missing class counts as unclassified."""
    pairs = [F.lit(v) for item in ROAD_LEVELS.items() for v in item]
    known = F.try_element_at(F.create_map(*pairs), F.coalesce(col(highway), F.lit("unclassified")))
    return F.coalesce(known, F.lit(UNKNOWN_ROAD_LEVEL))


def is_main_road(highway) -> Column:
    return road_level(highway) <= 5


def is_residential(highway) -> Column:
    return F.coalesce(col(highway).isin("residential", "living_street"), F.lit(False))


def restricted_access(*tags) -> Column:
    """True if any of the access tags forbids through traffic."""
    found = F.lit(False)
    for tag in tags:
        found = found | F.coalesce(col(tag).isin(RESTRICTED_VALUES), F.lit(False))
    return found


def crossing_confidence(crossings, routes) -> Column:
    return F.least(F.lit(0.95), col(crossings) / col(routes) * 0.5 + 0.5)


def swap_axes(points) -> Column:
    """[[lon, lat], ...] to [[lat, lon], ...]."""
    return F.transform(col(points), lambda p: F.array(p[1], p[0]))


def address_line(street, postcode, city) -> Column:
    """"street, postcode city" with commas and blanks cut from both ends."""
    text = F.concat(
        F.coalesce(col(street), F.lit("")),
        F.lit(", "),
        F.coalesce(col(postcode), F.lit("")),
        F.lit(" "),
        F.coalesce(col(city), F.lit("")),
    )
    return F.regexp_replace(text, r"^[, ]+|[, ]+$", "")
