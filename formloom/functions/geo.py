"""Geopoints: "latitude longitude altitude accuracy". Great-circle formulas on a sphere of the earth's mean radius."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import keyed_random, number_text

RADIUS = 6_371_008.8  # metres


def point(c: Column) -> Column:
    """The text as lat, lon, alt, acc; NULL where it is no point."""
    parts = F.split(F.trim(c), r"\s+")
    at = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    fine = at(0).between(-90, 90) & at(1).between(-180, 180)
    return F.when(fine, F.struct(at(0).alias("lat"), at(1).alias("lon"), at(2).alias("alt"), at(3).alias("acc")))


def points(c: Column) -> Column:
    """The points of a trace or shape, separated by semicolons."""
    return F.filter(F.transform(F.split(c, ";"), point), lambda p: p.isNotNull())


def distance(a: Column, b: Column) -> Column:
    """Metres between two parsed points."""
    lat_a, lat_b = F.radians(a["lat"]), F.radians(b["lat"])
    h = F.pow(F.sin((lat_b - lat_a) / 2), F.lit(2.0)) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), F.lit(2.0))
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def area(ring: Column) -> Column:
    """Square metres within an array of points, whether or not it ends where it began."""
    n = F.size(ring)

    def side(p: Column, k: Column) -> Column:
        q = F.get(ring, F.when(k + 1 < n, k + 1).otherwise(F.lit(0)))
        return F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"])))

    total = F.aggregate(F.transform(ring, side), F.lit(0.0), lambda a, x: a + x)
    return F.abs(total) * F.lit(RADIUS * RADIUS / 2)


def scatter(c: Column, metres: Column, *key: Column) -> Column:
    """A point at most ``metres`` away, the same each time for the same key; even over the disc."""
    p = point(c)
    turn = keyed_random(*key, F.lit("bearing")) * F.lit(6.283185307179586)
    far = F.sqrt(keyed_random(*key, F.lit("radius"))) * metres
    lat = p["lat"] + F.degrees(far * F.cos(turn) / RADIUS)
    lon = p["lon"] + F.degrees(far * F.sin(turn) / (RADIUS * F.greatest(F.cos(F.radians(p["lat"])), F.lit(1e-9))))
    return F.when(p.isNotNull(), F.concat_ws(" ", lat.cast("string"), lon.cast("string"), F.coalesce(number_text(p["alt"]), F.lit("0")), F.coalesce(number_text(p["acc"]), F.lit("0"))))


def short(c: Column) -> Column:
    """Longitude and latitude only, in this order."""
    parts = F.split(F.trim(c), r"\s+")
    return F.when(point(c).isNotNull(), F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))
