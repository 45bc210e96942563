"""Points on the globe, as latitude and longitude in degrees; distances in kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed by the geohash format


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def within_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, km: float) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2) <= km


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial course in degrees from north, 0 to 360."""
    turn = F.radians(lng2 - lng1)
    east = F.sin(turn) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def destination(lat: Column, lng: Column, km: float, course: float) -> Column:
    """The point km away on a course, as struct(lat, lng)."""
    arc, turn, phi = F.lit(km / EARTH_KM), F.radians(F.lit(course)), F.radians(lat)
    there = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(turn))
    moved = F.radians(lng) + F.atan2(F.sin(turn) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(there))
    return F.struct(F.degrees(there).alias("lat"), F.degrees(moved).alias("lng"))


def bbox(lat: Column, lng: Column, km: float) -> Column:
    """struct(min_lat, min_lng, max_lat, max_lng) around a point."""
    d_lat = F.lit(km / EARTH_KM * 57.29577951308232)
    d_lng = d_lat / F.cos(F.radians(lat))
    return F.struct((lat - d_lat).alias("min_lat"), (lng - d_lng).alias("min_lng"), (lat + d_lat).alias("max_lat"), (lng + d_lng).alias("max_lng"))


def as_text(lat: Column, lng: Column) -> Column:
    return F.concat(F.lit("POINT("), lat.cast("string"), F.lit(" "), lng.cast("string"), F.lit(")"))


def geohash(lat: Column, lng: Column, digits: int = 6) -> Column:
    """Geohash by arithmetic: each axis as an integer of its bits, the bits dealt out alternately."""
    n_lng, n_lat = (digits * 5 + 1) // 2, digits * 5 // 2
    on = lambda x, low, span, n: F.least(F.lit((1 << n) - 1), F.floor((x - low) / span * (1 << n)).cast("long"))
    x, y = on(lng, -180.0, 360.0, n_lng), on(lat, -90.0, 180.0, n_lat)
    bits = [F.shiftright(x, n_lng - 1 - i // 2) % 2 if i % 2 == 0 else F.shiftright(y, n_lat - 1 - i // 2) % 2 for i in range(digits * 5)]
    letters = []
    for d in range(digits):
        value = sum((b * (1 << (4 - i)) for i, b in enumerate(bits[d * 5 : d * 5 + 5])), F.lit(0).cast("long"))
        letters.append(F.substring(F.lit(GEOHASH_DIGITS), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)
