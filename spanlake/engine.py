"""The engine: stages of a search put together for many recordings and many queries at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import candidates as c
from spanlake.operators import evidence as e
from spanlake.operators import folds, refine, verify
from spanlake.sources.scratch import materialize
from spanlake.sources.tables import number_matches


@dataclass(frozen=True)
class SearchSettings:
    """Parameters of a search. weights are a plan's, after normalisation."""

    weights: dict[str, float] = field(default_factory=lambda: {"video": 0.5, "metadata": 0.5})
    bin_size: float = 2.0
    smoothing: int = 1
    gap: float = 10.0
    padding: float = 10.0
    max_candidates: int = 20
    expected_max: float = 0.0
    best_only: bool = False
    nms: float = 0.55
    refine_boundaries: bool = False


def search(hits: DataFrame, videos: DataFrame, settings: SearchSettings = SearchSettings(), rules: DataFrame | None = None, backend: verify.ModelBackend | None = None, keys: list[str] = e.KEYS) -> dict[str, DataFrame]:  # noqa: B006, B008
    """evidence, candidates, and numbered matches of every query in every video; without a backend the matches are the
    refined candidates themselves, unverified. A query without evidence in a video takes its candidates from rank fusion.

    hits: schema.HITS (ranked); videos: keys, duration, one row for each query and video that is searched."""
    timeline = materialize(e.evidence_map(hits, videos, settings.weights, keys, settings.bin_size, settings.smoothing))
    relative = 0.15 if settings.best_only else 0.05
    regions = c.candidates_from_evidence(timeline, videos, keys, settings.gap, settings.padding, relative)
    leaves = refine.refine_candidates(regions, timeline, videos, keys, settings.bin_size, settings.expected_max, best_only=settings.best_only)
    # queries whose timeline is empty fall back on the fusion of their ranks
    lost = hits.join(regions.select(*keys).distinct(), keys, "left_anti")
    fused = c.cluster_fused(c.fuse_ranks(lost, settings.weights, keys), videos, keys, gap=settings.gap, padding=settings.padding, relative=relative)
    leaves = leaves.unionByName(fused, allowMissingColumns=True)
    if rules is not None:
        leaves = c.apply_ordering(leaves, hits, rules, keys)
    leaves = c.limit_candidates(leaves, settings.max_candidates, keys)
    if backend is None:
        found = c.as_instances(leaves, keys)
    else:
        first = verify.verify_candidates(leaves.join(videos.select(*keys, "duration"), keys), backend, keys)
        found = verify.confirm_instances(first.join(videos.select(*keys, "duration"), keys), backend, keys).drop("duration", "candidate_id").withColumn("verified", F.lit(True))
    kept = folds.temporal_nms(found, keys, settings.nms)
    if settings.best_only:
        kept = verify.best_only(kept, keys)
    if backend is not None and settings.refine_boundaries:
        named = materialize(kept.join(videos.select(*keys, "duration"), keys).withColumn("__id", F.xxhash64(*keys, "start", "end", "confidence", "description")))
        kept = verify.refine_boundaries(named, backend, "__id").drop("__id", "duration")
    return {"evidence": timeline, "candidates": leaves, "matches": number_matches(kept, keys)}
