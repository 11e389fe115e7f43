"""Recursive refinement of candidates, as a fixed number of levels.

The timeline of a row's video and query is joined once, as an array of its bins' scores; from there every level is
expressions on arrays and an explode: no shuffle until the leaves of one query are compared at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.intervals import iou
from spanlake.operators.candidates import number, window_value
from spanlake.operators.evidence import KEYS
from spanlake.operators.folds import greedy_keep
from spanlake.operators.windows import child_windows

STEP = "struct<depth:int,parent_start:double,parent_end:double,child_start:double,child_end:double,child_score:double>"


def _value(start: Column, end: Column, size: float) -> Column:
    """Window score over the array __scores of the bins that overlap [start, end)."""
    lo = F.floor(start / size).cast("int")
    hi = F.least(F.size("__scores"), F.ceil(end / size).cast("int"))
    part = F.slice("__scores", F.greatest(lo, F.lit(0)) + 1, F.greatest(hi - F.greatest(lo, F.lit(0)), F.lit(0)))
    return window_value(part)


def refine_candidates(
    candidates: DataFrame, evidence: DataFrame, videos: DataFrame, keys: list[str] = KEYS, size: float = 2.0, expected_max: float = 0.0, depth: int = 3,
    shrink: float = 0.5, overlap: float = 0.5, relative: float = 0.6, children: int = 2, least: float = 12.0, padding: float = 4.0, best_only: bool = False,
) -> DataFrame:
    """Leaves of each candidate's recursion, padded, without those near a better one: keys, candidate_id, start, end, score,
    recursive_depth, recursive_root_id, recursive_support_bins, recursive_history, search_stage.

    A node is a leaf at the last level, at a width near the target, or if no part of it has evidence; else up to `children`
    of its windows go on, the best ones that are not nearly the same."""
    target = max(float(least), 1.5 * max(0.0, expected_max))
    most = 1 if best_only else max(1, int(children))
    series = evidence.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin_id", "score"))), lambda b: b["score"]).alias("__scores"))
    nodes = candidates.join(series, keys).select(
        *keys, F.col("candidate_id").alias("recursive_root_id"), "__scores",
        F.struct(F.col("start"), F.col("end"), F.greatest("score", _value(F.col("start"), F.col("end"), size)).alias("score"), F.lit(0).alias("depth"), F.lit(False).alias("leaf"), F.array().cast(f"array<{STEP}>").alias("history")).alias("n"),
    )
    for level in range(depth):
        n = F.col("n")
        width = n["end"] - n["start"]
        child = F.greatest(F.lit(target), width * shrink)
        ends_here = n["leaf"] | (width <= target * 1.05) | (child >= width * 0.98)
        windows = F.transform(child_windows(n["start"], n["end"], child, overlap), lambda w: F.struct((-_value(w["start"], w["end"], size)).alias("loss"), w["start"].alias("start"), w["end"].alias("end")))
        nodes = nodes.withColumn("w", F.when(~ends_here, F.array_sort(windows)))
        top = -F.element_at("w", 1)["loss"]
        strong = F.filter("w", lambda w: -w["loss"] >= top * relative)
        apart = F.aggregate(strong, F.slice(strong, 1, 0), lambda kept, w: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: iou(k["start"], k["end"], w["start"], w["end"]) > 0.85), kept).otherwise(F.concat(kept, F.array(w))))
        step = lambda w: F.struct(F.lit(level + 1).alias("depth"), n["start"].alias("parent_start"), n["end"].alias("parent_end"), w["start"].alias("child_start"), w["end"].alias("child_end"), (-w["loss"]).alias("child_score"))  # noqa: B023, E731
        down = F.transform(apart, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), (-w["loss"]).alias("score"), F.lit(level + 1).alias("depth"), F.lit(False).alias("leaf"), F.concat(n["history"], F.array(step(w))).alias("history")))
        # (the functions run here and now, in this level) a leaf goes on as it is: one lineage for all levels, nothing is computed twice
        nodes = nodes.select(*keys, "recursive_root_id", "__scores", F.explode(F.when(F.col("w").isNotNull() & (top > 0), down).otherwise(F.array(n.withField("leaf", F.lit(True))))).alias("n"))
    found = nodes.select(*keys, "recursive_root_id", "__scores", "n.start", "n.end", "n.score", F.col("n.depth").alias("recursive_depth"), F.col("n.history").alias("recursive_history"))
    lo, hi = F.floor(F.col("start") / size), F.least(F.size("__scores"), F.ceil(F.col("end") / size))
    found = found.withColumn("recursive_support_bins", F.greatest(F.lit(0), hi - lo).cast("long")).drop("__scores")
    padded = found.join(videos.select(*keys, "duration"), keys).withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - padding), "end": F.least("duration", F.col("end") + padding)}).drop("duration")
    merge = 0.8 * max(float(least), target)
    same = lambda k, d: (F.abs((k["start"] + k["end"]) / 2 - (d["start"] + d["end"]) / 2) < merge) | (iou(k["start"], k["end"], d["start"], d["end"]) > 0.65)
    kept = greedy_keep(padded, keys, [-F.round("score", 9), F.col("start"), F.col("end"), F.col("recursive_root_id")], same)
    return number(kept, keys, [F.desc(F.round("score", 9)), "start", "end", "recursive_root_id"]).withColumn("search_stage", F.lit("recursive_evidence_search"))
