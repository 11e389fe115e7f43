"""Small projections and filters that a user of the results needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transcript_filter(segments: DataFrame, wanted: str) -> DataFrame:
    """Segments whose text has the wanted words, in any case; all of them for a blank wish."""
    wanted = wanted.strip().lower()
    return segments.where(F.lower("text").contains(wanted)) if wanted else segments


def highlight(text: Column, wanted: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """text with every occurrence of wanted, in any case, between two marks."""
    wanted = wanted.strip()
    quoted = wanted.replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_replace(text, rf"(?i)(\Q{quoted}\E)", f"{before}$1{after}") if wanted else text


def index_outdated(index: Column, scene_model: str, frame_limit: int, version: int) -> Column:
    """Whether an index (a struct) was made by another model, another limit or another version; null for no index."""
    return (index["scene_model"] != scene_model) | (index["frame_limit"] != frame_limit) | (index["version"] != version)


def missing_models(required: Column, installed: Column) -> Column:
    """Required model names that are not installed; a name without a tag means its `:latest`."""
    full = lambda names: F.transform(names, lambda n: F.when(n.contains(":"), n).otherwise(F.concat(n, F.lit(":latest"))))
    return F.array_except(full(required), full(installed))


def scene_records(scenes: DataFrame, events: str = "important_events") -> DataFrame:
    """scenes (chunk_id, scale, start, end and a described scene's fields) whose events also have absolute_start and
    absolute_end, seconds of the recording; their own count from the chunk's start. Null events stay null."""
    at = lambda e, side: F.col("start") + e[f"{side}_seconds"]
    return scenes.withColumn(events, F.transform(events, lambda e: e.withField("absolute_start", at(e, "start")).withField("absolute_end", at(e, "end"))))


def search_history(searches: DataFrame) -> DataFrame:
    """Searches newest first with the numbers that a list of them shows."""
    return searches.select("id", "video_id", "created_at", "status", "query", "mode", F.size("matches").alias("n_matches")).orderBy(F.desc("created_at"))
