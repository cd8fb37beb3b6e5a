"""Safe casts, times, points and JSON access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_nan(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin("nan", ""), None).otherwise(c)


def to_int(c: Column) -> Column:
    """Whole number or null; decimal fractions are cut as Python's int() of a float does."""
    return F.coalesce(c.try_cast("bigint"), F.when(c.cast("string").rlike(r"^-?\d+\.\d*$"), c.try_cast("double").try_cast("bigint")))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def to_bool(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "t", "1", "yes")


def epoch_seconds(c: Column) -> Column:
    return F.timestamp_micros((c.try_cast("double") * 1_000_000).cast("bigint"))


def epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("double").cast("bigint"))


def twitter_time(c: Column) -> Column:
    """``Wed Oct 10 20:19:24 +0000 2018``; the weekday is not checked."""
    return F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def any_time(c: Column) -> Column:
    """ISO forms, compact yyyyMMddHHmm[ss] and yyyyMMddHH; naive times are UTC."""
    s = F.trim(c.cast("string"))
    compact = [F.when(F.length(s) == len(p), F.try_to_timestamp(s, F.lit(p))) for p in ("yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMddHH")]
    digits = s.rlike(r"^\d+$")
    return F.when(digits, F.coalesce(*compact)).otherwise(F.try_to_timestamp(s))


def point(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("SRID=4326;POINT("), lon.cast("double").cast("string"), F.lit(" "), lat.cast("double").cast("string"), F.lit(")")))


def lon_lat(location: Column) -> tuple[Column, Column]:
    part = lambda k: F.regexp_extract(location, r"POINT\s*\(\s*([-\d.eE+]+)\s+([-\d.eE+]+)\s*\)", k).try_cast("double")
    return part(1), part(2)


def within(location: Column, lon: float, lat: float, radius: float) -> Column:
    """Planar distance in degrees; the box comes first as it is cheaper."""
    x, y = lon_lat(location)
    return x.between(lon - radius, lon + radius) & y.between(lat - radius, lat + radius) & (F.hypot(x - lon, y - lat) <= radius)


def json_double(body: Column, *paths: str) -> Column:
    """The first of the JSON paths that holds a number."""
    return F.coalesce(*[F.get_json_object(body, p).try_cast("double") for p in paths])


def in_window(c: Column, start=None, end=None) -> Column:
    """start <= c < end; either bound may be missing."""
    out = F.lit(True)
    if start is not None:
        out = out & (c >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (c < F.lit(end).cast("timestamp"))
    return out
