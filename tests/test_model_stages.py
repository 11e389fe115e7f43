"""Stages that ask a model: plans, scenes, on-screen text, speech, frames, clips; kept answers, failures and invalid answers."""

import json
import os
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanlake import schema
from spanlake.operators import planning, reading
from spanlake.sources import index, media
from spanlake.sources import tables as t

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

LISTS = ("people", "objects", "actions", "interactions", "motion_events", "state_changes", "visible_text", "search_terms")
PLAN = {
    "query_type": "event", "executor": "temporal_grounding", "routing_reason": "", "return_mode": "all", "target_object": "x", "target_region": "", "text_description": "",
    "extraction_instruction": "", "visual_queries": ["door opens"], "metadata_queries": [], "transcript_queries": [], "target_event": "door opens",
    "evidence_predicates": [{"id": "p0", "description": " handle ", "role": "cue", "modalities": ["video"], "required": True, "importance": 2.0}], "negative_evidence": [" "],
    "temporal_constraints": [], "ordering": [], "subevents": [], "expected_duration": {"min_seconds": 1.0, "max_seconds": 5}, "requires_temporal_order": False,
    "event_definition": {"counts_as_match": [], "does_not_count": []}, "weights": {"video": 2.0, "metadata": 2.0, "transcript_semantic": 0.0, "transcript_bm25": 0.0},
}


def scene(said: str) -> str:
    return json.dumps({"summary": said, "scene": "", **{k: [] for k in LISTS}, "important_events": [{"start_seconds": 1.0, "end_seconds": 2.0, "description": said}]})


class Model:
    """Shows GATE 5 from second 33 to 37, boxed in the frames; knows no plan for `unfit`, is down for chunks from 60 on."""

    def __init__(self, down_from: float = 60.0):
        self.down_from = down_from

    def plan(self, queries):
        return pd.Series([json.dumps(PLAN if q != "unfit" else PLAN | {"executor": "other"}) for q in queries])

    def describe(self, rows):
        if (rows["start"] >= self.down_from).any():
            raise RuntimeError("down")
        return pd.Series([scene(f"door {s:.0f}") for s in rows["start"]])

    def embed_text(self, texts, task):
        return pd.Series([[float(x.count("door")), float(x.count("window")), 0.1] for x in texts])

    def scan(self, rows):
        seen = lambda s, e: [{"start_seconds": 33 - s, "end_seconds": 37 - s, "best_frame_seconds": 35 - s, "confidence": 0.6, "ocr_text": "GATE S", "target_description": "sign", "visual_evidence": "", "readable": True}] if s <= 33 < e else []
        return pd.Series([json.dumps({"items": seen(s, e)}) for s, e in zip(rows["window_start"], rows["window_end"], strict=True)])

    def read_frames(self, rows):
        one = lambda i, at: {"image_index": i, "target_present": bool(33 <= at <= 37), "ocr_text": " GATE  5 ", "readable": True, "confidence": 0.7, "target_description": "sign", "bbox": {"x1": 100.0, "y1": 100.0, "x2": 300.0, "y2": 200.0}}
        return pd.Series([json.dumps({"readings": [one(i, at) for i, at in enumerate(times)] + [one(99, 35)]}) for times in rows["times"]])

    def read_crops(self, rows):
        return pd.Series([json.dumps({"readings": [{"image_index": i, "ocr_text": "GATE 5", "readable": True, "confidence": 0.9} for i in range(len(c))]}) for c in rows["crops"]])

    def sharpness(self, rows):
        return 100 - (rows["timestamp"] - 34).abs()

    def transcribe(self, rows):
        some = {"words": [{"start": 0.0, "end": 1.0, "word": "door"}], "segments": [{"start": 0.0, "end": 1.0, "text": " door "}]}
        return pd.Series([json.dumps({"words": [], "segments": []} if p == "mute" else some if p != "bad" else {"words": 1}) for p in rows["path"]])


def test_json_fits_a_schema(spark):
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string("a double, b array<struct<c int>>, d boolean")
    assert schema.fits({"a": 1, "b": [{"c": 2}], "d": True}, kind)
    for bad in ({"a": True, "b": [], "d": True}, {"a": 1, "b": [{"c": 1.5}], "d": True}, {"a": 1, "b": None, "d": True}, {"a": 1, "b": []}, {"a": 1, "b": [], "d": True, "e": 0}, []):
        assert not schema.fits(bad, kind)


def test_plans_are_checked_and_cleaned(spark):
    asked = spark.createDataFrame([("q", "door opens"), ("u", "unfit")], "query_id string, query string")
    got = {r["query_id"]: r for r in planning.plan_queries(asked, Model(), pause=0.0).collect()}
    plan = got["q"]["plan"]
    assert (plan["weights"]["video"], plan["target_object"], plan["negative_evidence"]) == (0.5, "", [])
    assert (plan["evidence_predicates"][0]["description"], plan["evidence_predicates"][0]["importance"]) == ("handle", 1.0)
    assert got["q"]["error"] is None and got["u"]["plan"] is None and "schema" in got["u"]["error"]


def test_scenes_are_described_once_and_searched(spark, tmp_path):
    chunks = spark.createDataFrame([("v", "medium", f"m{i}", 30.0 * i, 30.0 * i + 30) for i in range(3)], "video_id string, scale string, chunk_id string, start double, end double")
    path = str(tmp_path / "scenes")
    failed = planning.describe_scenes(chunks, Model(), path, attempts=2, pause=0.0).collect()
    assert [(r["chunk_id"], "down" in r["error"]) for r in failed] == [("m2", True)]
    kept = {r["chunk_id"]: r for r in planning.read_scenes(spark, path).collect()}
    assert set(kept) == {"m0", "m1"} and kept["m1"]["important_events"][0]["absolute_start"] == 31.0
    assert kept["m1"]["text"] == "Summary: door 30\nImportant events: door 30"
    assert planning.describe_scenes(chunks, Model(1e9), path, attempts=1, pause=0.0).count() == 0
    assert planning.read_scenes(spark, path).count() == 3


def test_text_index_is_searched_by_meaning_and_by_words(spark, tmp_path):
    rows = spark.createDataFrame([("v", "a", 0.0, 30.0, "a door opens"), ("v", "b", 15.0, 45.0, " "), ("w", "a", 0.0, 30.0, "a window breaks"), ("x", "a", 0.0, 30.0, "rain")], "video_id string, chunk_id string, start double, end double, text string")
    folder = str(tmp_path / "texts")
    index.build_text_index(rows, Model(), folder, "s")
    asked = spark.createDataFrame([(0, "window")], "query_id int, query string")
    for backend, second in ((Model(), "x"), (None, "v")):  # by words the others tie at 0, the least id first
        found = index.search_texts(spark, folder, asked, 2, backend, "s").orderBy("rank").collect()
        assert [(r["video_id"], r["chunk_id"], r["rank"]) for r in found] == [("w", "a", 0), (second, "a", 1)]
    with pytest.raises(t.IndexVersionMismatch):
        index.search_texts(spark, folder, asked, 2, None, "other")


def test_on_screen_text_the_whole_way(spark):
    videos = spark.createDataFrame([("v", "q", 90.0, "which gate"), ("w", "q", 20.0, "which gate")], "video_id string, query_id string, duration double, query string")
    got = reading.read_texts(videos, Model())
    match = got["matches"].collect()
    assert [(r["video_id"], r["match_id"], r["start"], r["end"], r["ocr_text"], r["readable"]) for r in match] == [("v", 0, 33.0, 37.0, "GATE 5", True)]
    assert match[0]["ocr_confidence"] == pytest.approx(0.9) and match[0]["confidence"] == pytest.approx(0.9)
    assert match[0]["best_timestamp"] == 34.0 and match[0]["description"] == "visible text: GATE 5"
    assert [(r["text"], r["appearances"]) for r in got["entities"].collect()] == [("GATE 5", [0])]
    assert got["failed"].count() == 0
    assert reading.read_texts(videos, Model(), return_mode="best")["matches"].count() == 1


def test_a_failing_window_is_told_and_costs_no_other(spark):
    class Broken(Model):
        def scan(self, rows):
            if (rows["window_start"] > 50).any():
                raise RuntimeError("down")
            return super().scan(rows)

    videos = spark.createDataFrame([("v", "q", 90.0, "which gate")], "video_id string, query_id string, duration double, query string")
    failed: list = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr("spanlake.operators.verify.time.sleep", lambda s: None)
        assert reading.scan_texts(videos, Broken(), failed=failed).count() == 1
    assert [(r["stage"], r["video_id"]) for r in failed[0].collect()] == [("scan", "v"), ("scan", "v")]


def test_speech_of_files(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "mute"), ("c", "bad")], "video_id string, path string")
    words, segments, failed = media.transcribe(files, Model(), attempts=2, pause=0.0)
    assert [(r["video_id"], r["word"]) for r in words.collect()] == [("a", "door")]
    assert [(r["video_id"], r["text"]) for r in segments.collect()] == [("a", "door")]
    assert [r["video_id"] for r in failed.collect()] == ["c"]


def test_answers_are_kept_by_key(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, n int")
    asked = []

    def make(todo):
        asked.extend(sorted(r["key"] for r in todo.collect()))
        return todo.withColumn("twice", F.col("n") * 2)

    folder = str(tmp_path / "kept")
    assert media.cached(rows.where("n = 1"), folder, "key", make).count() == 1
    assert {r["key"]: r["twice"] for r in media.cached(rows, folder, "key", make).collect()} == {"k1": 2, "k2": 4}
    assert asked == ["k1", "k2"]


def test_frames_in_batches(spark):
    def encode(rows):
        assert len(rows) <= 2
        return pd.Series([[[s, 0.0], [0.0, s]] for s in rows["time"]])

    frames = spark.range(5).select(F.lit("v").alias("video_id"), F.lit("p").alias("path"), F.col("id").cast("double").alias("time"))
    got = media.frame_vectors(frames, encode, 2)
    assert got.count() == 10 and sorted((r["t"], r["vec"]) for r in got.where("view = 1").collect())[4] == (4.0, [0.0, 4.0])


def test_clips_are_cut_once_and_failures_told(spark, tmp_path):
    def cut(path, start, end, target):
        if os.path.exists(target):
            return
        with open(f"{target}.part", "w") as f:
            f.write(f"{path} {start} {end}")
        os.replace(f"{target}.part", target)

    rows = spark.createDataFrame([("v", "c0", "/m/a b.mp4", 1.0, 2.0, 0), ("v", "c1", "/m/a b.mp4", 2.0, 2.0, 1), ("v", "c2", "/m/a b.mp4", 5.0, 6.0, 2)], "video_id string, clip_id string, path string, start double, end double, rank int")
    got = {r["clip_id"]: r for r in media.write_clips(rows, str(tmp_path), cut, most=2).collect()}
    assert set(got) == {"c0", "c1"} and os.path.basename(got["c0"]["clip_path"]).startswith("clip_a_b_") and os.path.exists(got["c0"]["clip_path"])
    assert got["c1"]["clip_path"] is None and "longer" in got["c1"]["error"]


def test_results_are_published_at_every_depth(spark):
    kind = "id int, results_file string, matches array<struct<clip_path string, inner struct<path string, top_evidence_bins array<int>>>>, candidates array<struct<start double, end double, score double, secret string>>, evidence_map array<struct<start double, end double, score double>>"
    bins = [(float(i), i + 1.0, i / 10) for i in range(5)]
    rows = spark.createDataFrame([(1, "r", [("/lib/v/c.mp4", ("/etc/passwd", [1])), ("/lib/../x", None)], [(0.0, 1.0, 0.5, "s")], bins), (2, None, None, None, [])], kind)
    got = {r["id"]: r.asDict(True) for r in t.publish(rows, "/lib", "/f/", 2).collect()}
    assert got[1] == {
        "id": 1, "matches": [{"clip_url": "/f/v/c.mp4", "inner": {"url": None}}, {"clip_url": None, "inner": None}], "candidates": [{"start": 0.0, "end": 1.0, "score": 0.5}],
        "evidence_map": [{"start": 0.0, "end": 3.0, "score": 0.2}, {"start": 3.0, "end": 5.0, "score": 0.4}],
    }
    assert got[2] == {"id": 2, "matches": None, "candidates": None, "evidence_map": []}
