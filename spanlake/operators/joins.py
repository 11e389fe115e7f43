"""Joins on intervals and times as equi-joins: intervals are dealt to grid cells, and each pair is kept in one cell only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cells(rows: DataFrame, cell: float, start: str, end: str, first: str, at: str) -> DataFrame:
    lo = F.floor(F.col(start) / cell).cast("long")
    hi = F.greatest(lo, (F.ceil(F.col(end) / cell) - 1).cast("long"))
    return rows.withColumn(first, lo).withColumn(at, F.explode(F.sequence(lo, hi)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("r_start", "r_end"), how: str = "inner") -> DataFrame:
    """Pairs of the same keys whose half-open intervals overlap. Column names of the two sides must differ but for the keys.

    Each side is dealt to the cells of a grid that it touches, joined on keys and cell, and a pair counts in the cell where
    the later of the two begins: so long intervals spread over tasks and no pair comes twice. how: inner or left.
    """
    (ls, le), (rs, re) = left_span, right_span
    if how == "left":
        left = left.withColumn("__row", F.xxhash64(*[F.col(c) for c in left.columns if not left.schema[c].dataType.typeName() == "map"]))
    a, b = _cells(left, cell, ls, le, "__la", "__cell"), _cells(right, cell, rs, re, "__ra", "__cell")
    hit = (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col("__cell") == F.greatest("__la", "__ra"))
    pairs = a.join(b, [*keys, "__cell"]).where(hit).drop("__cell", "__la", "__ra")
    if how == "inner":
        return pairs
    alone = left.join(pairs.select(*keys, "__row").distinct(), [*keys, "__row"], "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True).drop("__row")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, columns: list[str]) -> DataFrame:
    """left with the columns of the right row that has the latest right_time at or before time; null if there is none.

    Both sides are sorted together once, by keys and time; at equal times the right row counts as earlier."""
    blank = lambda names, rows: [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    others = [c for c in left.columns if c not in keys]
    taken = [right_time, *[c for c in columns if c != right_time]]
    a = left.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), *others, F.lit(None).cast(right.select(F.struct(*taken)).schema[0].dataType).alias("__r"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *blank(others, left), F.struct(*taken).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return merged.select(*keys, *others, *[F.col(f"__r.{c}").alias(c) for c in taken])
