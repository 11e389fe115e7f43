import datetime as dt
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanlake.operators import scoring, verify
from spanlake.operators.windows import multiscale_chunks
from spanlake.sources import tables as t
from spanlake.streaming import events


def test_index_round_trip_and_version(spark, tmp_path):
    chunks = multiscale_chunks(spark.createDataFrame([("v", 40.0)], "video_id string, duration double"))
    t.write_index({"chunks": chunks}, str(tmp_path / "i"), "s")
    assert t.load_index(spark, str(tmp_path / "i"), "s")["chunks"].count() == chunks.count()
    with pytest.raises(t.IndexVersionMismatch):
        t.load_index(spark, str(tmp_path / "i"), version=1)
    with pytest.raises(t.IndexVersionMismatch):
        t.load_index(spark, str(tmp_path / "i"), "other")
    manifest = t.nest_manifest(spark.createDataFrame([("v", 40.0)], "video_id string, duration double"), chunks)
    assert t.flatten_manifest(manifest).count() == chunks.count()


def test_resume_skips_what_is_done_and_returns_failures(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "chunk_id string")
    broken = lambda d: d.withColumn("error", F.when(F.col("chunk_id") == "m1", "model down"))
    assert [r["chunk_id"] for r in t.append_resumable(rows, path, ["chunk_id"], broken).collect()] == ["m1"]
    seen = []
    fixed = lambda d: (seen.extend(r["chunk_id"] for r in d.collect()), d.withColumn("error", F.lit(None).cast("string")))[1]
    assert t.append_resumable(rows, path, ["chunk_id"], fixed).count() == 0
    assert seen == ["m1"] and t.read_jsonl(spark, path, "chunk_id string").count() == 3


def test_ingest_names_by_content(spark):
    files = spark.createDataFrame([("/a.mp4", bytearray(b"x"), 5.0, True), ("/b.mov", bytearray(b"x"), 5.0, True), ("/c.txt", bytearray(b"y"), 5.0, True), ("/d.mp4", bytearray(b"z"), 0.0, True)], "path string, content binary, duration double, has_video boolean")
    got = t.ingest(files)
    assert [r["name"] for r in got.collect()] == ["a.mp4"] and len(got.first()["video_id"]) == 16
    assert t.ingest(files, got).count() == 0


def test_recovery(spark):
    records = spark.createDataFrame([("a", "indexing"), ("b", "queued"), ("c", "ready")], "video_id string, status string")
    got = {r["video_id"]: r["status"] for r in t.recover_records(records, spark.createDataFrame([("a",)], "video_id string")).collect()}
    assert got == {"a": "ready", "b": "interrupted", "c": "ready"}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


class Fake:
    """A model that sees an event at second 33."""

    def verify(self, rows):
        return pd.Series([[{"start_seconds": 33 - s, "end_seconds": 37 - s, "confidence": 0.8, "description": "", "actor_description": "", "visual_evidence": ""}] if s <= 33 < e else [] for s, e in zip(rows["start"], rows["end"], strict=True)])

    def confirm(self, rows):
        return pd.DataFrame({"valid": True, "confidence": 0.9, "start_seconds": 33 - rows["window_start"], "end_seconds": 37 - rows["window_start"]})

    def boundary(self, rows):
        at = rows["side"].map({"start": 33.5, "end": 36.5})
        return pd.DataFrame({"contains_boundary": (rows["probe_start"] <= at) & (at <= rows["probe_end"]), "confidence": 0.9, "boundary_seconds": at - rows["probe_start"]})

    def embed_text(self, texts, task):
        return pd.Series([[float(len(x)), 1.0] for x in texts])


def test_model_stages_with_a_fake(spark):
    cand = spark.createDataFrame([("v", "q", 0, 20.0, 60.0, 100.0), ("v", "q", 1, 30.0, 50.0, 100.0)], "video_id string, query_id string, candidate_id int, start double, end double, duration double")
    first = verify.verify_candidates(cand, Fake())
    assert [(r["start"], r["end"]) for r in first.collect()] == [(33.0, 37.0)]
    second = verify.confirm_instances(first.withColumn("duration", F.lit(100.0)), Fake())
    assert [(r["start"], r["end"], r["pro_verified"]) for r in second.collect()] == [(33.0, 37.0, True)]
    moved = verify.refine_boundaries(second.withColumn("id", F.lit(1)), Fake(), "id").first()
    assert (moved["start"], moved["end"], moved["boundary_refined"]) == (33.5, 36.5, True)
    vec = verify.embed_texts(spark.createDataFrame([("a b",)], "text string"), Fake()).first()["vec"]
    assert sum(x * x for x in vec) == pytest.approx(1)


def test_retries_raise_the_last_error():
    calls = []

    def call():
        calls.append(1)
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        verify.with_retries(call, 2)
    assert len(calls) == 2


def test_scoring(spark):
    labels = spark.createDataFrame([("a", 10.0, 20.0, None), ("b", None, None, "Gate 5")], "id string, true_start double, true_end double, true_text string")
    found = spark.createDataFrame([("a", 0, 0.0, 5.0, None), ("a", 1, 10.0, 21.0, None), ("b", 0, 0.0, 1.0, "GATE-5")], "id string, match_id long, start double, end double, text string")
    got = {r["id"]: r for r in scoring.score_rows(labels, found).collect()}
    assert (got["a"]["best_iou"], got["a"]["top1_iou"], got["a"]["best_rank"], got["a"]["correct"]) == (0.909, 0.0, 2, True)
    assert got["b"]["text_exact"] and got["b"]["correct"]
    summary = scoring.summarize(scoring.score_rows(labels, found).withColumn("seconds", F.lit(2.0))).first()
    assert (summary["count"], summary["correct"], summary["mean_iou"], summary["text_exact"]) == (2, 2, 0.909, 1.0)


def test_streaming_bins(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("v", "video", base + dt.timedelta(seconds=s), 0.5) for s in (0, 1, 5)]
    spark.createDataFrame(rows, "video_id string, channel string, ts timestamp, contribution double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, channel string, ts timestamp, contribution double").parquet(str(tmp_path / "in"))
    q = events.live_bins(stream).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["q"], r["hits"]) for r in spark.table("bins").collect()) == [(0.5, 1), (0.75, 2)]


def test_islands_over_sessions(spark):
    base = dt.datetime(2024, 1, 1)
    bins = spark.createDataFrame([("v", base + dt.timedelta(seconds=s), 2.0, 0.5) for s in (0, 2, 14, 40)], "video_id string, ts timestamp, length_seconds double, score double")
    assert sorted(r["num_supporting_bins"] for r in events.live_islands(bins).collect()) == [1, 3]
