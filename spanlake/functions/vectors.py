"""Expressions on vectors (array<float> or array<double>), computed in double precision in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """a at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def view_score(views: Column, query: Column) -> Column:
    """The best view's dot product: views is an array of vectors."""
    return F.array_max(F.transform(views, lambda v: dot(v, query)))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys and the mean vector, summed dimension by dimension, so no group is gathered."""
    parts = rows.select(*keys, F.posexplode(vector).alias("__d", "__x"))
    means = parts.groupBy(*keys, "__d").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__d", "__x"))), lambda p: p["__x"]).alias(vector))
