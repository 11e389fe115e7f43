"""The whole search's other ways: rank fusion without evidence, moved bounds, explicit parents, the persisted index, failing rows."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanlake.engine import SearchSettings, search
from spanlake.functions.intervals import safe_stem
from spanlake.operators import retrieval, scoring, verify
from spanlake.sources import index
from spanlake.sources import tables as t

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIT = "video_id string, query_id string, channel string, ranking long, rank int, start double, end double, score double, importance double"


class Model:
    """Answers about seconds 33 to 37; fails for windows that begin at 100 or later."""

    def verify(self, rows):
        if (rows["start"] >= 100).any():
            raise RuntimeError("down")
        return pd.Series([[{"start_seconds": 33 - s, "end_seconds": 37 - s, "confidence": 0.8, "description": "", "actor_description": "", "visual_evidence": ""}] if s <= 33 < e else [] for s, e in zip(rows["start"], rows["end"], strict=True)])

    def confirm(self, rows):
        return pd.DataFrame({"valid": True, "confidence": 0.9, "start_seconds": 33 - rows["window_start"], "end_seconds": 37 - rows["window_start"]})

    def boundary(self, rows):
        at = rows["side"].map({"start": 33.5, "end": 36.5})
        return pd.DataFrame({"contains_boundary": (rows["probe_start"] <= at) & (at <= rows["probe_end"]), "confidence": 0.9, "boundary_seconds": at - rows["probe_start"]})

    def embed_text(self, texts, task):
        return pd.Series([[float(len(x)), 1.0] for x in texts])


def test_without_evidence_ranks_are_fused(spark):
    hits = spark.createDataFrame([("v", "q", "video", 0, 0, 30.0, 38.0, -0.5, 1.0), ("v", "p", "video", 0, 0, 50.0, 58.0, 0.9, 1.0)], HIT)
    videos = spark.createDataFrame([("v", "q", 120.0), ("v", "p", 120.0)], "video_id string, query_id string, duration double")
    found = search(hits, videos, SearchSettings(weights={"video": 1.0}))
    stages = {r["query_id"]: r["search_stage"] for r in found["candidates"].collect()}
    assert stages == {"q": "rank_fusion", "p": "recursive_evidence_search"}
    assert {r["query_id"] for r in found["matches"].where("start <= 34 and end >= 34 or start <= 54 and end >= 54").collect()} == {"p", "q"}
    counts = {r["query_id"]: (r["candidates"], r["matches"]) for r in scoring.funnel({"candidates": found["candidates"], "matches": found["matches"]}, ["video_id", "query_id"]).collect()}
    assert counts == {"q": (1, 1), "p": (1, 1)}


def test_bounds_are_moved_in_a_search(spark):
    hits = spark.createDataFrame([("v", "q", "video", 0, 0, 30.0, 38.0, 0.9, 1.0), ("v", "q", "video", 0, 1, 100.0, 108.0, 0.8, 1.0)], HIT)
    videos = spark.createDataFrame([("v", "q", 140.0)], "video_id string, query_id string, duration double")
    found = search(hits, videos, SearchSettings(weights={"video": 1.0}, refine_boundaries=True), backend=Model())["matches"].collect()
    assert [(r["start"], r["end"], r["boundary_refined"]) for r in found] == [(33.5, 36.5, True)]


def test_explicit_parents_come_first(spark):
    rows = [("v", "coarse", "c0", 0.0, 100.0, [0.2, 0.98], None), ("v", "coarse", "c1", 100.0, 200.0, [1.0, 0.0], None), ("v", "fine", "f0", 10.0, 20.0, [1.0, 0.0], ["c1"]), ("v", "fine", "f1", 30.0, 40.0, [1.0, 0.0], None)]
    chunks = spark.createDataFrame(rows, "video_id string, scale string, chunk_id string, start double, end double, vec array<double>, parent_ids array<string>")
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, qvec array<double>")
    got = {r["chunk_id"]: r["score"] for r in retrieval.hierarchical_search(ask, chunks, 2, ("coarse", "fine")).collect()}
    assert got["f0"] == pytest.approx(1.0) and got["f1"] == pytest.approx(0.7 + 0.3 * 0.2)


def test_index_is_built_and_searched(spark, tmp_path):
    videos = spark.createDataFrame([("v", 40.0)], "video_id string, duration double")
    frames = spark.createDataFrame([("v", float(s), w, [1.0, 0.0] if (s == 22) == (w == 0) else [0.0, 1.0]) for s in range(40) for w in (0, 1)], "video_id string, t double, view int, vec array<double>")
    index.build_index(videos, frames, str(tmp_path / "i"), "s")
    ask = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, qvec array<double>")
    flat = index.search_index(spark, str(tmp_path / "i"), ask, 3, "fine", "s")
    beam = index.search_index(spark, str(tmp_path / "i"), ask, 3)
    assert flat.count() == beam.count() == 3
    with pytest.raises(t.IndexVersionMismatch):
        index.search_index(spark, str(tmp_path / "i"), ask, 3, None, "other")


def test_prefix_of_texts_and_pieces_of_visual_ones(spark):
    rows = spark.createDataFrame([("a b",)], "text string")
    long = spark.createDataFrame([(" ".join(["w"] * 80),)], "text string")
    one = verify.embed_texts(rows, Model(), task="query").first()["vec"]
    assert one[0] / one[1] == pytest.approx(len("search_query: a b"))
    two = verify.embed_visual_texts(long, Model()).first()["vec"]
    assert two[0] / two[1] == pytest.approx(79)  # two pieces of 40 words, without prefix


def test_names_and_paths(spark):
    names = [r["x"] for r in spark.createDataFrame([("a b.mp4",), (".mp4",), ("x" * 90 + ".mov",)], "n string").select(safe_stem(F.col("n")).alias("x")).collect()]
    assert names == ["a_b", "video", "x" * 80]
    files = spark.createDataFrame([(f"/a.{e}", bytearray(e, "utf8"), 5.0, True) for e in ("mp4", "m4v", "mov", "mkv", "webm", "avi", "mpg", "ts", "wmv", "flv", "3gp")], "path string, content binary, duration double, has_video boolean")
    assert t.ingest(files).count() == 6
    shown = t.publish(spark.createDataFrame([("clips/a.mp4", "/etc/x")], "path string, frame_path string")).first().asDict()
    assert shown == {"url": "/files/clips/a.mp4", "frame_url": None}
    assert retrieval.spoken(spark.createDataFrame([(" ",), ("x",)], "text string")).count() == 1
