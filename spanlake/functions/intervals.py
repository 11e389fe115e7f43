"""Expressions on half-open intervals [start, end) in seconds, and how times and cache keys are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part, 0 if there is none."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common part over hull; the hull of overlapping intervals is their union. 0 for an empty hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(0.0)


def rounded(value: Column, places: int) -> Column:
    """Rounded as C and DuckDB do, by a product in doubles; F.round takes the shortest decimals of the value instead, and of
    a half that doubles don't hold (0.5005, three places) it makes another number."""
    return F.round(value * F.lit(10.0**places)) / F.lit(10.0**places)


def time_bin(seconds: Column, size: float) -> Column:
    return F.floor(seconds / F.lit(float(size))).cast("long")


def format_timestamp(seconds: Column) -> Column:
    """[HH:]MM:SS of whole seconds, cut off."""
    s = F.floor(F.greatest(F.lit(0.0), seconds)).cast("long")
    minutes = F.format_string("%02d:%02d", F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(s >= 3600, F.concat(F.format_string("%02d:", F.floor(s / 3600).cast("long")), minutes)).otherwise(minutes)


def format_timestamp_precise(seconds: Column) -> Column:
    """[HH:]MM:SS.ss."""
    h, m = F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long")
    tail = F.format_string("%02d:%05.2f", m, seconds % 60)
    return F.when(h > 0, F.concat(F.format_string("%02d:", h), tail)).otherwise(tail)


def safe_stem(text: Column) -> Column:
    """A file name's stem with runs of other signs than letters, digits, '.', '_' and '-' as one '_': its first 80 signs, or
    `video` if there are none."""
    stem = F.regexp_replace(F.regexp_replace(text, r"\.[^./\\]*$", ""), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.substring(stem, 1, 80), F.lit("")), F.lit("video"))


def interval_cache_key(path: Column, start: Column, end: Column, prefix: str = "interval") -> Column:
    """prefix, stem, eight digits of the path's sha1, and both bounds in milliseconds (half to even)."""
    ms = lambda x: F.bround(x * 1000, 0).cast("long")
    return F.format_string("%s_%s_%s_%010d_%010d", F.lit(prefix), safe_stem(F.element_at(F.split(path, r"[/\\]"), -1)), F.substring(F.sha1(path), 1, 8), ms(start), ms(end))


def query_folder(query: Column) -> Column:
    """The results' folder name of a query."""
    return F.substring(F.sha1(query), 1, 10)
