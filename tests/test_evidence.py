import itertools
import math

import pytest
from pyspark.sql import functions as F

from spanlake.engine import SearchSettings, search
from spanlake.operators import candidates as cd
from spanlake.operators import evidence as ev
from spanlake.operators import folds, refine

KEYS = ["video_id", "query_id"]
HIT = "video_id string, query_id string, channel string, ranking int, rank int, start double, end double, score double, importance double, predicate_id string"


def hits(spark, rows):
    return spark.createDataFrame([("v", "q", *r) for r in rows], HIT)


def videos(spark, duration):
    return spark.createDataFrame([("v", "q", float(duration))], "video_id string, query_id string, duration double")


def scores(df):
    return [round(r["score"], 6) for r in df.orderBy("bin_id").collect()]


def test_calibration(spark):
    rows = hits(spark, [("video", 0, 0, 0.0, 1.0, 0.9, 1.0, None), ("video", 0, 1, 0.0, 1.0, 0.2, 1.0, None), ("metadata", 0, 0, 0.0, 1.0, 0.3, 1.0, None), ("negative", 0, 0, 0.0, 1.0, 0.0, 1.0, None)])
    got = {(r["channel"], r["rank"]): r["calibrated"] for r in ev.calibrate(rows).collect()}
    assert got["video", 0] == 1 and got["metadata", 0] == 1 and got["negative", 0] == 0
    assert got["video", 1] == pytest.approx(0.2 / 0.9 * (0.05 + 0.7 * math.exp(-0.5)), abs=1e-9)


def test_one_hit_makes_a_smoothed_peak_and_a_region(spark):
    one = hits(spark, [("video", 0, 0, 10.0, 18.0, 0.9, 1.0, None)])
    timeline = ev.evidence_map(one, videos(spark, 40), {"video": 1.0})
    assert scores(timeline) == [0] * 4 + [0.25, 0.75, 1, 1, 0.75, 0.25] + [0] * 10
    region = cd.candidates_from_evidence(timeline, videos(spark, 40)).collect()
    assert [(r["start"], r["end"], r["score"], r["evidence_mass"], r["num_supporting_bins"]) for r in region] == [(0.0, 30.0, 1.0, 4.0, 6)]


def test_negative_evidence_halves_it_and_never_goes_below_zero(spark):
    both = hits(spark, [("video", 0, 0, 10.0, 18.0, 0.9, 1.0, None), ("negative", 0, 0, 10.0, 18.0, 0.9, 1.0, None), ("negative", 1, 0, 30.0, 34.0, 0.9, 1.0, None)])
    got = scores(ev.evidence_map(both, videos(spark, 40), {"video": 1.0}))
    assert min(got) == 0 and max(got) < 1


def test_ranking_whose_hits_all_lie_outside_still_counts_for_the_mean(spark):
    rows = [("video", 0, 0, 10.0, 18.0, 0.9, 1.0, None), ("video", 1, 0, 90.0, 99.0, 0.9, 1.0, None)]
    assert max(scores(ev.evidence_map(hits(spark, rows), videos(spark, 40), {"video": 1.0}))) == pytest.approx(0.9)


def test_noisy_or_does_not_depend_on_order(spark):
    base = [("video", 0, i, 10.0 + i, 18.0 + i, 0.9 - i / 10, 0.5, None) for i in range(4)]
    results = {tuple(scores(ev.evidence_map(hits(spark, list(p)), videos(spark, 40), {"video": 1.0}))) for p in itertools.islice(itertools.permutations(base), 0, 24, 11)}
    assert len(results) == 1 and all(0 <= x <= 1 for x in results.pop())


def test_refinement_keeps_distinct_windows(spark):
    timeline = ev.evidence_map(hits(spark, [("video", 0, 0, 10.0, 18.0, 0.9, 1.0, None)]), videos(spark, 40), {"video": 1.0})
    windows = spark.createDataFrame([("v", "q", 0.0, 15.0), ("v", "q", 7.5, 22.5), ("v", "q", 15.0, 30.0)], "video_id string, query_id string, start double, end double")
    got = {r["start"]: round(r["window_score"], 6) for r in cd.window_scores(windows, timeline).collect()}
    assert got == {0.0: 0.9375, 7.5: 0.915278, 15.0: 0.88125}
    leaves = refine.refine_candidates(cd.candidates_from_evidence(timeline, videos(spark, 40)), timeline, videos(spark, 40), expected_max=6.0).collect()
    assert leaves and all(0 <= r["start"] < r["end"] <= 40 for r in leaves) and leaves[0]["recursive_history"]


def brute_refine(series, roots, duration, target=12.0):
    """Row at a time: the recursion over one timeline of two-second bins."""

    def value(s, e):
        v = sorted((x for i, x in enumerate(series) if i * 2 + 2 > s and i * 2 < e), reverse=True)
        k = max(1, math.ceil(len(v) * 0.25))
        return 0.55 * v[0] + 0.35 * sum(v[:k]) / k + 0.10 * sum(v) / len(v) if v else 0.0

    def iou(a, b):
        hull = max(a[1], b[1]) - min(a[0], b[0])
        return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / hull

    leaves, todo = [], [(s, e, max(x, value(s, e)), 0) for s, e, x in roots]
    while todo:
        s, e, x, depth = todo.pop()
        width, child = e - s, max(target, (e - s) / 2)
        picked = []
        if depth < 3 and width > 1.05 * target and child < 0.98 * width:
            stride, at, parts = max(0.25, child / 2), s, []
            while True:
                at_ = min(at, e - child)
                parts.append((at_, at_ + child))
                if at + child >= e - 1e-9:
                    break
                at += stride
            ranked = sorted(((value(*p), p) for p in dict.fromkeys(parts)), key=lambda v: (-v[0], v[1]))
            if ranked[0][0] > 0:
                for v, p in ranked:
                    if v >= 0.6 * ranked[0][0] and len(picked) < 2 and all(iou(p, q) <= 0.85 for _, q in picked):
                        picked.append((v, p))
        if picked:
            todo += [(*p, v, depth + 1) for v, p in picked]
        else:
            leaves.append((max(0.0, s - 4), min(duration, e + 4), x))
    kept = []
    for leaf in sorted(leaves, key=lambda v: (-round(v[2], 9), v[0], v[1])):
        if all(abs(sum(leaf[:2]) - sum(k[:2])) / 2 >= 0.8 * target and iou(leaf, k) <= 0.65 for k in kept):
            kept.append(leaf)
    return [tuple(round(x, 6) for x in k) for k in kept]


def test_refinement_equals_a_row_at_a_time_model(spark):
    import random

    rng = random.Random(5)
    found = [("video", i % 3, i // 3, s := rng.uniform(0, 290), s + rng.uniform(2, 9), rng.random(), rng.random(), None) for i in range(40)]
    timeline = ev.evidence_map(hits(spark, found), videos(spark, 300), {"video": 1.0})
    roots = cd.candidates_from_evidence(timeline, videos(spark, 300), relative=0.3)
    series = [r["score"] for r in timeline.orderBy("bin_id").collect()]
    want = brute_refine(series, [(r["start"], r["end"], r["score"]) for r in roots.collect()], 300.0)
    got = refine.refine_candidates(roots, timeline, videos(spark, 300)).orderBy("candidate_id").collect()
    assert [(round(r["start"], 6), round(r["end"], 6), round(r["score"], 6)) for r in got] == want


def test_ordering(spark):
    rows = [("video", 0, 0, 0.0, 4.0, 0.9, 1.0, "a"), ("video", 1, 0, 10.0, 14.0, 0.9, 1.0, "b"), ("video", 1, 1, 30.0, 34.0, 0.9, 1.0, "b"), ("video", 0, 1, 40.0, 44.0, 0.9, 1.0, "a")]
    cand = spark.createDataFrame([("v", "q", 0, 30.0, 50.0, 0.5), ("v", "q", 1, 0.0, 20.0, 0.5)], "video_id string, query_id string, candidate_id int, start double, end double, score double")
    rules = spark.createDataFrame([("q", "a", "b")], "query_id string, first string, then string")
    got = cd.apply_ordering(cand, hits(spark, rows), rules).orderBy("candidate_id").collect()
    assert [(r["start"], r["ordering_satisfied"], r["ordering_violated"], round(r["score"], 4)) for r in got] == [(0.0, 1, 0, 0.575), (30.0, 0, 1, 0.375)]


DET = "video_id string, query_id string, start double, end double, confidence double, actor_description string"


def test_suppression(spark):
    rows = [("v", "q", 0.0, 10.0, 0.9, "red coat"), ("v", "q", 1.0, 11.0, 0.8, "red coat"), ("v", "q", 1.0, 11.0, 0.7, "blue hat"), ("v", "q", 0.5, 10.5, 0.6, ""), ("v", "q", 30.0, 40.0, 0.5, "a person")]
    df = spark.createDataFrame(rows, DET)
    assert sorted(r["confidence"] for r in folds.temporal_nms(df).collect()) == [0.5, 0.7, 0.9]
    plain = spark.createDataFrame(rows[:4], DET)  # the same rows without a vague one are folded in the JVM
    assert sorted(r["confidence"] for r in folds.temporal_nms(plain).collect()) == [0.7, 0.9]
    assert sorted(r["confidence"] for r in folds.deduplicate(plain, limit=0.65).collect()) == [0.7, 0.9]


def test_kept_detections_do_not_suppress_each_other(spark):
    df = spark.range(60).select(F.lit("v").alias("video_id"), F.lit("q").alias("query_id"), (F.col("id") * 7 % 50).cast("double").alias("start"), (F.col("id") * 7 % 50 + 10).cast("double").alias("end"), (F.col("id") * 13 % 60 / 60).alias("confidence"), F.lit("").alias("actor_description"))
    kept = folds.temporal_nms(df).collect()
    for a, b in itertools.combinations(kept, 2):
        assert max(0.0, min(a["end"], b["end"]) - max(a["start"], b["start"])) / (max(a["end"], b["end"]) - min(a["start"], b["start"])) < 0.55


def test_quick_search_finds_the_peak(spark):
    rows = [("video", 0, 0, 30.0, 38.0, 0.9, 1.0, None), ("video", 0, 1, 70.0, 78.0, 0.2, 1.0, None)]
    found = search(hits(spark, rows), videos(spark, 120), SearchSettings(weights={"video": 1.0}, expected_max=6.0))
    got = found["matches"].collect()
    assert any(r["start"] <= 30 and r["end"] >= 38 for r in got) and not any(r["verified"] for r in got)
    assert found["evidence"].count() == 60


def test_downsampling_keeps_peaks_and_ends(spark):
    rows = spark.range(5000).select(F.lit("v").alias("video_id"), F.lit("q").alias("query_id"), F.col("id").alias("bin_id"), F.col("id").cast("double").alias("start"), (F.col("id") + 1).cast("double").alias("end"), F.when(F.col("id") == 3333, 1.0).otherwise(0.1).alias("score"))
    got = ev.downsample(rows, 500).collect()
    assert len(got) <= 500 and max(r["score"] for r in got) == 1 and min(r["start"] for r in got) == 0 and max(r["end"] for r in got) == 5000
