"""Geospatial sets: sorted sets whose scores are 52-bit geohashes."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.geo import RADIUS, UNITS, covering_ranges, distance, geo_position, geo_score, geo_text


def geoadd(places: DataFrame) -> DataFrame:
    """(key, member, lon, lat) to (key, member, score); places off the globe are refused. With a seq
    this is a log that ``zsets.zadd`` takes, with its NX and XX, and ``zsets.zadd_replies`` counts CH."""
    off = (F.abs("lon") > 180) | (F.abs("lat") > 90)
    score = F.when(off, F.raise_error(F.lit("invalid longitude,latitude pair"))).otherwise(geo_score(F.col("lon"), F.col("lat")))
    return places.select("key", "member", score.cast("double").alias("score"), *[c for c in places.columns if c == "seq"])


def geopos(z: DataFrame) -> DataFrame:
    """With the cell's centre."""
    lon, lat = geo_position(F.col("score"))
    return z.withColumns({"lon": lon, "lat": lat})


def geohash(z: DataFrame) -> DataFrame:
    return z.withColumn("geohash", geo_text(F.col("score")))


def geodist(z: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """pairs: (key, a, b); dist null where either is absent."""
    pos = geopos(z)
    side = lambda n: pos.select("key", F.col("member").alias(n), F.col("lon").alias(f"lon_{n}"), F.col("lat").alias(f"lat_{n}"))
    both = pairs.join(side("a"), ["key", "a"], "left").join(side("b"), ["key", "b"], "left")
    return both.select("key", "a", "b", distance(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"), unit).alias("dist"))


def _in_box(lon: float, lat: float, width: float, height: float) -> Column:
    """Within width and height metres of the centre's box, distances measured along each axis."""
    here = (F.lit(lon), F.lit(lat))
    return (distance(here[0], F.col("lat"), F.col("lon"), F.col("lat")) <= width / 2) & (distance(here[0], here[1], here[0], F.col("lat")) <= height / 2)


def _spans(lat: float, reach: float, half_width: float | None) -> tuple[float, float]:
    """Degrees of longitude and latitude that hold a circle of ``reach`` metres, or the box of that
    half height and of ``half_width``."""
    d_lat = math.degrees(reach / RADIUS) + 1e-6
    top = abs(lat) + d_lat
    if top >= 90:
        return 180.0, d_lat
    if half_width is None:
        s, scale = math.sin(reach / RADIUS) / math.cos(math.radians(lat)), 1
    else:
        s, scale = math.sin(min(half_width / (2 * RADIUS), math.pi / 2)) / math.cos(math.radians(top)), 2
    return (scale * math.degrees(math.asin(s)) + 1e-6 if s < 1 else 180.0), d_lat


def near(score: Column, lon: float, lat: float, d_lon: float, d_lat: float) -> Column:
    """Whether a score is in one of the few ranges that cover the spans, which a scan of stored scores
    can skip by."""
    return reduce(or_, [score.between(float(lo), float(hi)) for lo, hi in covering_ranges(lon, lat, d_lon, d_lat)])


def geosearch(z: DataFrame, lon: float, lat: float, *, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int = 0, any_: bool = False, desc: bool = False) -> DataFrame:
    """Members of every key within a radius or a (width, height) box, with lon, lat and dist.

    Ranges of scores that cover the shape are tested first, so only members near it are decoded, and of
    a stored set, which is what this is meant for, a scan skips what lies outside them;
    count takes the nearest of each key (farthest with ``desc``), or with ``any_`` whichever come first.
    """
    scale = UNITS[unit]
    reach = (radius if radius is not None else box[1] / 2) * scale
    rows = geopos(z.where(near(F.col("score"), lon, lat, *_spans(lat, reach, box[0] * scale / 2 if radius is None else None))))
    rows = rows.withColumn("dist", distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit))
    rows = rows.where(F.col("dist") <= radius) if radius is not None else rows.where(_in_box(lon, lat, box[0] * scale, box[1] * scale))
    if not count:
        return rows
    order = [F.col("member")] if any_ else [F.col("dist").desc() if desc else F.col("dist").asc(), F.col("member")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("_n") <= count).drop("_n")


def geosearch_member(z: DataFrame, member, **how) -> DataFrame:
    """From the place of a member of one key; fails where it is absent."""
    at = geopos(z.where(F.col("member") == F.lit(member))).select("lon", "lat").first()  # one row
    if at is None:
        raise KeyError("could not decode requested zset member")
    return geosearch(z, at["lon"], at["lat"], **how)


def geosearchstore(found: DataFrame, dest, *, storedist: bool = False) -> DataFrame:
    """A sorted set of the members found, scored by geohash or by distance."""
    return found.select(F.lit(dest).alias("key"), "member", F.col("dist" if storedist else "score").alias("score"))
