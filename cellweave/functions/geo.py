"""Geographic Column functions; degrees in, kilometres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
MERCATOR_M = 6378137.0


def _rad(x: Column) -> Column:
    return F.radians(x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a = F.pow(F.sin(_rad(lat2 - lat1) / 2), 2) + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * F.pow(F.sin(_rad(lon2 - lon1) / 2), 2)
    clipped = F.when(a.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)))
    return 2 * EARTH_KM * F.asin(F.sqrt(clipped))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point, clockwise from north, in [0, 360)."""
    y = F.sin(_rad(lon2 - lon1)) * F.cos(_rad(lat2))
    x = F.cos(_rad(lat1)) * F.sin(_rad(lat2)) - F.sin(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(_rad(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Where one arrives after ``km`` on a great circle."""
    d, b = km / EARTH_KM, _rad(bearing)
    lat2 = F.asin(F.sin(_rad(lat)) * F.cos(d) + F.cos(_rad(lat)) * F.sin(d) * F.cos(b))
    lon2 = _rad(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(_rad(lat)), F.cos(d) - F.sin(_rad(lat)) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical web-map coordinates in metres."""
    return MERCATOR_M * _rad(lon), MERCATOR_M * F.ln(F.tan(F.lit(3.141592653589793 / 4) + _rad(lat) / 2))


def smallest_angle(a: Column, b: Column) -> Column:
    """The angle between two directions, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def alignment_score(a: Column, b: Column) -> Column:
    return F.cos(_rad(smallest_angle(a, b)))


def is_shoreward(a: Column, b: Column, within: float = 45.0) -> Column:
    """1 if the directions are within ``within`` degrees, else 0; null if either is null."""
    return (smallest_angle(a, b) <= within).cast("int")


def alignment_category(a: Column, b: Column) -> Column:
    d = smallest_angle(a, b)
    return F.when(d <= 45, "aligned").when(d <= 135, "crosswind").when(d.isNotNull(), "opposite")


def bbox_wkt(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A closed polygon ring, anticlockwise from the lower left corner; null if a bound is."""
    text = F.format_string("POLYGON ((%.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f, %.4f %.4f))", minx, miny, maxx, miny, maxx, maxy, minx, maxy, minx, miny)
    return F.when(minx.isNotNull() & miny.isNotNull() & maxx.isNotNull() & maxy.isNotNull(), text)


def cell_wkt(lat: Column, lon: Column, size: float = 0.1) -> Column:
    return bbox_wkt(lon - size / 2, lat - size / 2, lon + size / 2, lat + size / 2)


def in_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Crossing-number test against an array of edges ``(x1, y1, x2, y2)`` of closed rings."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
