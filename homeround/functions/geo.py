"""Geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
DEPOT = (-2.9348, 43.2630)

#: The ellipsoid and the zone of the projection.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257222101
SCALE, FALSE_EASTING, CENTRAL_MERIDIAN = 0.9996, 500_000.0, -3.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; the root's argument is held to 1 at antipodes."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def project_utm30n(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres by the series of the transverse Mercator projection."""
    e2 = FLATTENING * (2 - FLATTENING)
    second = e2 / (1 - e2)
    phi = F.radians(lat)
    radius = SEMI_MAJOR / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c = F.pow(F.tan(phi), 2), second * F.pow(F.cos(phi), 2)
    a = F.radians(lon - CENTRAL_MERIDIAN) * F.cos(phi)
    arc = [
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, phi),
        (-(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), F.sin(2 * phi)),
        (15 * e2**2 / 256 + 45 * e2**3 / 1024, F.sin(4 * phi)),
        (-(35 * e2**3 / 3072), F.sin(6 * phi)),
    ]
    meridian = SEMI_MAJOR * sum((k * x for k, x in arc[1:]), arc[0][0] * arc[0][1])
    east = a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(a, 5) / 120
    north = (
        F.pow(a, 2) / 2
        + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(a, 6) / 720
    )
    return FALSE_EASTING + SCALE * radius * east, SCALE * (meridian + radius * F.tan(phi) * north)


def polygon_wkt(rings: Column) -> Column:
    """MULTIPOLYGON text of an array of rings of (lon, lat); null if a ring has under 3 positions. An open ring is closed."""
    closed = F.transform(
        rings,
        lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))),
    )
    shown = F.transform(
        closed,
        lambda r: F.concat(F.lit("(("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["lon"], p["lat"])), ", "), F.lit("))")),
    )
    good = (F.size(rings) > 0) & F.forall(rings, lambda r: F.size(r) >= 3) & F.forall(closed, lambda r: F.size(r) >= 4)
    return F.when(good, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(shown, ", "), F.lit(")")))
