"""Candidate intervals: islands of strong bins, window scores, rank fusion, ordering rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.evidence import CHANNELS, KEYS
from spanlake.operators.joins import overlap_join

#: Factors of a candidate's score for a satisfied and a violated rule; the fusion's rank offset.
BONUS, PENALTY, FUSION_K = 1.15, 0.75, 60


def islands(rows: DataFrame, keys: list[str], gap: float, start: str = "start", end: str = "end") -> DataFrame:
    """island: number of the run of intervals that follow one another with at most the gap between."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("__new", F.coalesce(F.col(start) > reach + F.lit(float(gap)), F.lit(True)).cast("int"))
    return flagged.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def number(rows: DataFrame, keys: list[str], order: list, name: str = "candidate_id") -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def _regions(rows: DataFrame, videos: DataFrame, keys: list[str], gap: float, padding: float, mass: str, count: str) -> DataFrame:
    grouped = islands(rows, keys, gap).groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.sum("score").alias(mass), F.count("*").alias(count), F.array_sort(F.collect_list("bin_id")).alias("bin_ids")
    )
    padded = grouped.join(videos.select(*keys, "duration"), keys).withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - padding), "end": F.least("duration", F.col("end") + padding)})
    return number(padded.drop("island", "duration"), keys, [F.desc("score"), F.desc(mass), F.desc(count), "start"])


def candidates_from_evidence(evidence: DataFrame, videos: DataFrame, keys: list[str] = KEYS, gap: float = 10.0, padding: float = 10.0, relative: float = 0.05, absolute: float = 0.02) -> DataFrame:
    """Regions of bins that reach the floor min(best, max(absolute, best * relative)); none where the best is 0."""
    best = F.max("score").over(Window.partitionBy(*keys))
    floor = F.least("__best", F.greatest(F.lit(absolute), F.col("__best") * relative))
    strong = evidence.withColumn("__best", best).where((F.col("__best") > 0) & (F.col("score") >= floor))
    return _regions(strong, videos, keys, gap, padding, "evidence_mass", "num_supporting_bins").withColumn("search_stage", F.lit("evidence_component"))


def fuse_ranks(hits: DataFrame, weights: dict[str, float], keys: list[str] = KEYS, size: float = 5.0, k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion: for each bin of hits' centres the sum of weight / (k + rank + 1), and the hits' spans."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for c in CHANNELS for x in (c, float(weights.get(c, 0.0)))])[F.col("channel")], F.lit(0.0))
    placed = hits.where(F.col("channel").isin(*CHANNELS)).withColumn("bin_id", F.floor((F.col("start") + F.col("end")) / 2 / size).cast("long"))
    return placed.groupBy(*keys, "bin_id").agg(F.sum(weight / (k + F.col("rank") + 1)).alias("score"), F.count("*").alias("num_hits"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


def cluster_fused(fused: DataFrame, videos: DataFrame, keys: list[str] = KEYS, size: float = 5.0, gap: float = 10.0, padding: float = 10.0, relative: float = 0.05, most: int | None = None) -> DataFrame:
    """Regions of fused bins, each bin standing for its start plus and minus half its width."""
    best = fused.groupBy(*keys).agg(F.max("score").alias("__best")).where("__best > 0")
    strong = fused.join(best, keys).where(F.col("score") >= F.col("__best") * relative)
    if most:
        strong = number(strong, keys, [F.desc("score"), "bin_id"], "__n").where(F.col("__n") < most)
    at = F.col("bin_id") * F.lit(float(size))
    spans = strong.withColumns({"start": F.greatest(F.lit(0.0), at - size / 2), "end": at + size / 2})
    return _regions(spans, videos, keys, gap, padding, "fusion_mass", "num_supporting_hits").withColumn("search_stage", F.lit("rank_fusion"))


def window_value(scores: Column) -> Column:
    """0.55 peak + 0.35 mean of the best quarter + 0.10 mean of an array of scores; 0 for none."""
    ordered, n = F.sort_array(scores, asc=False), F.size(scores)
    quarter = F.greatest(F.lit(1), F.ceil(n * F.lit(0.25))).cast("int")
    # a mean first, then its share: the other way round a sum ending in a half at a rounded place can fall to its other side
    mean = lambda x, size: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / size
    value = F.lit(0.55) * F.element_at(ordered, 1) + F.lit(0.35) * mean(F.slice(ordered, 1, quarter), quarter) + F.lit(0.10) * mean(ordered, n)
    return F.when(n > 0, value).otherwise(0.0)


def window_scores(windows: DataFrame, evidence: DataFrame, keys: list[str] = KEYS, size: float = 2.0) -> DataFrame:
    """windows (keys, start, end) with window_score and support_bins, the bins that they overlap; by bins, no range join."""
    named = windows.withColumn("__id", F.xxhash64(*windows.columns))
    lo, hi = F.floor(F.col("start") / size).cast("long"), (F.ceil(F.col("end") / size) - 1).cast("long")
    met = named.where("end > start").select(*keys, "__id", F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("bin_id")).join(evidence.select(*keys, "bin_id", "score"), [*keys, "bin_id"])
    values = met.groupBy(*keys, "__id").agg(window_value(F.collect_list("score")).alias("window_score"), F.count("*").alias("support_bins"))
    return named.join(values, [*keys, "__id"], "left").drop("__id").na.fill({"window_score": 0.0, "support_bins": 0})


def predicate_peaks(hits: DataFrame, candidates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """For each candidate and predicate the centre of its best hit whose centre lies in the candidate; all channels count."""
    centre = (F.col("start") + F.col("end")) / 2
    points = hits.where("predicate_id is not null").select(*keys, "predicate_id", F.col("score").alias("hit_score"), centre.alias("p_start"), centre.alias("peak"), "channel", "ranking", "rank").withColumn("p_end", F.col("p_start") + F.lit(1e-9))
    inside = overlap_join(candidates.select(*keys, "candidate_id", "start", "end"), points, keys, 60.0, ("start", "end"), ("p_start", "p_end")).where("peak >= start and peak < end")
    return inside.groupBy(*keys, "candidate_id", "predicate_id").agg(F.max_by("peak", F.struct(F.col("hit_score"), -F.col("peak"))).alias("peak"), F.max("hit_score").alias("peak_score"))


def apply_ordering(candidates: DataFrame, hits: DataFrame, rules: DataFrame, keys: list[str] = KEYS, query_keys: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """candidates re-ranked: score x 1.15 for each rule (query_keys, first, then) whose peaks stand in order, x 0.75 for each
    that they violate; equal times are in order, rules with a peak missing don't count."""
    peaks = predicate_peaks(hits, candidates, keys)
    side = lambda name: peaks.select(*keys, "candidate_id", F.col("predicate_id").alias(name), F.col("peak").alias(f"__{name}"))
    pairs = side("first").join(rules.select(*query_keys, "first", "then").distinct(), [*query_keys, "first"]).join(side("then"), [*keys, "candidate_id", "then"])
    kept = F.col("__first") <= F.col("__then")
    counts = pairs.groupBy(*keys, "candidate_id").agg(F.count(F.when(kept, 1)).alias("ordering_satisfied"), F.count(F.when(~kept, 1)).alias("ordering_violated"))
    scored = candidates.join(counts, [*keys, "candidate_id"], "left")
    factor = F.pow(F.lit(BONUS), F.coalesce("ordering_satisfied", F.lit(0))) * F.pow(F.lit(PENALTY), F.coalesce("ordering_violated", F.lit(0)))
    return number(scored.withColumn("score", F.col("score") * factor).drop("candidate_id"), keys, [F.desc("score"), "start"])


def limit_candidates(candidates: DataFrame, most: int, keys: list[str] = KEYS) -> DataFrame:
    return candidates.where(F.col("candidate_id") < most)


def as_instances(candidates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Candidates as unverified detections, confidence = score."""
    text = lambda name: F.lit("").alias(name)
    return candidates.select(*keys, "start", "end", F.col("score").alias("confidence"), text("description"), text("actor_description"), text("visual_evidence"), F.lit(False).alias("verified"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
