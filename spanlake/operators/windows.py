"""Generators of windows: each a function of a row's numbers, made with sequence() and explode(), without a join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window and stride of the scales.
SCALES = {"coarse": (120.0, 60.0), "medium": (30.0, 15.0), "fine": (8.0, 4.0)}


def _positive(**values: float) -> None:
    for name, x in values.items():
        if not math.isfinite(x) or x <= 0:
            raise ValueError(f"{name} must be positive and finite, not {x}")


def _checked(length: Column) -> Column:
    bad = length.isNull() | F.isnan(length) | (length <= 0) | (length == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a duration must be positive and finite"))).otherwise(length)


def _grid(first: Column, last: Column, window: float, stride: float) -> Column:
    """Array of struct(idx, start, end): windows of a stretch at every stride until one reaches its end."""
    n = 1 + F.greatest(F.lit(0), F.ceil((last - first - window) / F.lit(stride)))
    return F.transform(
        F.sequence(F.lit(0).cast("long"), n.cast("long") - 1),
        lambda i: F.struct(i.alias("idx"), (first + i * F.lit(stride)).alias("start"), F.least(first + i * F.lit(stride) + F.lit(window), last).alias("end")),
    )


def _exploded(rows: DataFrame, windows: Column) -> DataFrame:
    return rows.withColumn("__w", F.explode(windows)).withColumns({k: F.col(f"__w.{k}") for k in ("idx", "start", "end")}).drop("__w")


def generate_windows(rows: DataFrame, window: float, stride: float, duration: str = "duration", min_final_fraction: float = 0.25) -> DataFrame:
    """rows x windows (idx, start, end) over [0, duration): bounds to three places; a last one shorter than the fraction of
    the window is dropped unless it is the only one."""
    _positive(window=window, stride=stride)
    out = _exploded(rows, _grid(F.lit(0.0), _checked(F.col(duration)), window, stride))
    if stride > (1 - min_final_fraction) * window:
        out = out.where((F.col("idx") == 0) | (F.col("end") - F.col("start") >= min_final_fraction * window))
    return out.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


def multiscale_chunks(videos: DataFrame, scales: dict[str, tuple[float, float]] = SCALES) -> DataFrame:
    """videos (video_id, duration) x scales x windows, with ids and file names."""
    parts = []
    for scale, (window, stride) in scales.items():
        w = generate_windows(videos.select("video_id", F.col("duration").alias("__length")), window, stride, "__length").drop("__length")
        chunk_id = F.format_string(f"{scale}_%06d", F.col("idx"))
        path = F.format_string("%s_%.3f_%.3f.mp4", chunk_id, F.col("start"), F.col("end"))
        parts.append(w.select("video_id", F.lit(scale).alias("scale"), "idx", chunk_id.alias("chunk_id"), "start", "end", F.round(F.col("end") - F.col("start"), 3).alias("duration"), path.alias("relative_path")))
    return reduce(DataFrame.unionByName, parts)


def scan_windows(rows: DataFrame, window: float = 30.0, overlap: float = 2.0, duration: str = "duration") -> DataFrame:
    """Windows for a scan of on-screen text; no leftover is dropped."""
    _positive(window=window)
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than the window")
    return _exploded(rows, _grid(F.lit(0.0), _checked(F.col(duration)), window, window - overlap))


def verifier_windows(rows: DataFrame, window: float = 25.0, overlap: float = 5.0, start: str = "start", end: str = "end") -> DataFrame:
    """Each interval as it is if it fits a window, else cut into overlapping windows; replaces start and end."""
    _positive(window=window)
    cut = rows.withColumns({"__s": F.col(start), "__e": F.col(end)}).drop(start, end)
    return _exploded(cut, _grid(F.col("__s"), F.col("__e"), window, max(0.5, window - overlap))).drop("__s", "__e")


def boundary_probes(rows: DataFrame, size: float, estimate: str = "estimate", duration: str = "duration") -> DataFrame:
    """Two windows around an estimated boundary, the one before it and the one about it: probe_start, probe_end.

    The start is held at 0 first, so a probe there keeps its length; one shorter than min(0.75, size) goes, and so does the
    second of two equal ones."""
    at = lambda shift: F.greatest(F.lit(0.0), F.col(estimate) - shift)
    probe = lambda s: F.struct(F.round(s, 6).alias("start"), F.round(F.least(F.col(duration), s + size), 6).alias("end"))
    out = rows.withColumn("__p", F.explode(F.array_distinct(F.array(probe(at(size)), probe(at(size / 2))))))
    out = out.withColumns({"probe_start": F.col("__p.start"), "probe_end": F.col("__p.end")}).drop("__p")
    return out.where(F.col("probe_end") - F.col("probe_start") >= min(0.75, size))


def child_windows(start: Column, end: Column, width: Column, overlap: float = 0.5) -> Column:
    """Array of struct(start, end): windows of a width over [start, end), the last moved back to keep the width."""
    stride = F.greatest(F.lit(0.25), width * (1 - overlap))
    n = (1 + F.ceil(F.greatest(F.lit(0.0), end - start - width) / stride - 1e-9)).cast("long")
    one = lambda i: F.struct(F.greatest(start, F.least(start + i * stride, end - width)).alias("start"), F.least(end, F.greatest(start, F.least(start + i * stride, end - width)) + width).alias("end"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), one))


def refine_times(rows: DataFrame, fps: float = 6.0, padding: float = 1.25, most: int = 14) -> DataFrame:
    """rows (start, end, best, duration) x times to look at: a grid about the best time and the interval's start, middle and
    end, within the interval padded; at most so many, those nearest to the best time."""
    _positive(fps=fps)
    lo, hi = F.greatest(F.lit(0.0), F.col("start") - padding), F.least(F.col("duration"), F.col("end") + padding)
    held = lambda t: F.round(F.greatest(lo, F.least(hi, t)), 4)
    steps = F.sequence(F.lit(-math.floor(padding * fps)), F.lit(math.floor(padding * fps)))
    grid = F.transform(steps, lambda k: held(F.col("best") + k / F.lit(fps)))
    anchors = F.array(*[held(x) for x in (F.col("start"), (F.col("start") + F.col("end")) / 2, F.col("end"), F.col("best"))])
    near = F.transform(F.array_distinct(F.concat(grid, anchors)), lambda t: F.struct(F.abs(t - F.col("best")).alias("d"), t.alias("t")))
    return rows.withColumn("time", F.explode(F.array_sort(F.transform(F.slice(F.array_sort(near), 1, most), lambda x: x["t"]))))


def frame_times(rows: DataFrame, fps: float = 4.0, most: int | None = None) -> DataFrame:
    """rows (start, end, source_fps) x evenly spaced times with both ends: time, frame_index; some evenly drawn if too many."""
    _positive(fps=fps)
    length = F.col("end") - F.col("start")
    n = F.greatest(F.lit(1), F.floor(length * fps) + 1).cast("long")
    at = lambda k: F.when(n == 1, F.col("start")).otherwise(F.col("start") + k * length / F.greatest(n - 1, F.lit(1)))
    places = F.sequence(F.lit(0).cast("long"), n - 1)
    if most:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (n - 1) / F.lit(max(1, most - 1))).cast("long"))
        places = F.when(n > most, drawn).otherwise(places)
    out = rows.withColumn("time", F.explode(F.transform(places, at)))
    return out.withColumn("frame_index", F.bround(F.col("time") * F.coalesce(F.col("source_fps"), F.lit(30.0)), 0).cast("long"))


def candidate_times(rows: DataFrame, fps: float = 1.0) -> DataFrame:
    """rows (start, end) x times from the start on at every 1/fps seconds, the end left out; an empty interval has none."""
    _positive(fps=fps)
    n = F.ceil((F.col("end") - F.col("start")) * fps).cast("long")
    places = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("time", F.explode(F.transform(places, lambda k: F.col("start") + k / F.lit(fps))))


def sample_times(rows: DataFrame, limit: int) -> DataFrame:
    """rows (start, end) x midpoints of equal parts, four a second, at most so many."""
    length = F.col("end") - F.col("start")
    n = F.greatest(F.lit(1), F.least(F.lit(limit), F.ceil(4 * length))).cast("long")
    return rows.withColumn("time", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.col("start") + (k + 0.5) * length / n)))


def tile_boxes(rows: DataFrame, grid: int = 2) -> DataFrame:
    """rows (height, width) x views: the whole frame (view 0) and grid x grid tiles with integer cuts."""
    h, w = F.col("height").cast("long"), F.col("width").cast("long")
    cut = lambda k, size: F.floor(k * size / grid).cast("long")
    whole = F.struct(F.lit(0).alias("view"), F.lit(0).cast("long").alias("top"), h.alias("bottom"), F.lit(0).cast("long").alias("left"), w.alias("right"))
    tiles = [F.struct(F.lit(1 + r * grid + c).alias("view"), cut(r, h).alias("top"), cut(r + 1, h).alias("bottom"), cut(c, w).alias("left"), cut(c + 1, w).alias("right")) for r in range(grid) for c in range(grid)]
    return rows.withColumn("__v", F.explode(F.array(whole, *tiles))).select("*", "__v.*").drop("__v")
