"""Column functions on coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two points in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def edge_at(e: dict[str, Column], lat: Column) -> Column:
    """Longitude at which the line through an edge (x0, y0, x1, y1) has latitude ``lat``; null for a level edge."""
    return e["x0"] + (lat - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) * (e["x1"] - e["x0"])


def point_in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd ray cast over closed rings, so holes count as outside.

    Half-open rule: an edge covers its lower end and not its upper one.
    """

    def crosses(a: Column, b: Column) -> Column:
        straddles = (a["y"] <= lat) != (b["y"] <= lat)
        at = edge_at({"x0": a["x"], "y0": a["y"], "x1": b["x"], "y1": b["y"]}, lat)
        return F.when(straddles & (lon < at), 1).otherwise(0)

    def crossings(ring: Column) -> Column:
        tail = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
        head = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
        return F.aggregate(F.zip_with(head, tail, crosses), F.lit(0), lambda total, n: total + n)

    total = F.aggregate(F.transform(rings, crossings), F.lit(0), lambda total, n: total + n)
    return total % 2 == 1
