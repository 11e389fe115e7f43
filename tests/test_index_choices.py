"""Scales of a saved index, names for all scales, candidate frames, events in a recording's time, keys of cached files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanlake.operators import scoring, views, windows
from spanlake.sources import index
from spanlake.sources import tables as t


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("saved") / "index")
    frames = [("v", float(s), 0, [1.0, 0.0] if s < 20 else [0.0, 1.0]) for s in range(40)]
    index.build_index(spark.createDataFrame([("v", 40.0)], "video_id string, duration double"), spark.createDataFrame(frames, "video_id string, t double, view int, vec array<double>"), folder, "s", {"long": (20.0, 10.0), "short": (5.0, 5.0)})
    return folder


def test_scales_of_an_index(spark, saved):
    assert index.saved_scales(spark, saved) == ["long", "short"]
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, qvec array<double>")
    for name in (None, "multi", "all"):
        rows = index.search_index(spark, saved, asked, 2, name).collect()
        assert len(rows) == 2 and all(r["chunk_id"].startswith("short") for r in rows)
        assert {(r["retrieval_mode"], r["retrieval_output_scale"], tuple(r["retrieval_scale_order"])) for r in rows} == {("hierarchical", "short", ("long", "short"))}
    rows = index.search_index(spark, saved, asked, 1, "long").collect()
    assert [(r["chunk_id"], r["retrieval_mode"], r["retrieval_scale_order"]) for r in rows] == [("long_000002", "single_scale", ["long"])]
    assert not index.search_index(spark, saved, asked, 0, "long").count() and not index.search_index(spark, saved, asked, 0).count()
    with pytest.raises(ValueError, match="no scale"):
        index.search_index(spark, saved, asked, 1, "medium")


def test_candidate_times_leave_the_end_out(spark):
    rows = spark.createDataFrame([("a", 1.0, 3.5), ("b", 2.0, 2.0), ("c", 0.0, 2.0)], "id string, start double, end double")
    got = {r["id"]: r["t"] for r in windows.candidate_times(rows).groupBy("id").agg(F.array_sort(F.collect_list("time")).alias("t")).collect()}
    assert got == {"a": [1.0, 2.0, 3.0], "c": [0.0, 1.0]}
    assert windows.candidate_times(rows.where("id = 'c'"), 2.0).count() == 4


def test_events_also_have_the_recordings_time(spark):
    schema = "chunk_id string, scale string, start double, end double, important_events array<struct<start_seconds:double,end_seconds:double,description:string>>"
    rows = spark.createDataFrame([("m0", "medium", 30.0, 60.0, [(1.0, 2.5, "door")]), ("m1", "medium", 45.0, 75.0, None)], schema)
    got = {r["chunk_id"]: r["important_events"] for r in views.scene_records(rows).collect()}
    assert [tuple(e) for e in got["m0"]] == [(1.0, 2.5, "door", 31.0, 32.5)] and got["m1"] is None


def test_a_video_that_the_library_lacks_is_an_error(spark):
    library = spark.createDataFrame([("x1", "one.mp4"), ("x2", "two.mp4")], "video_id string, name string")
    labels = spark.createDataFrame([("a", "x2"), ("b", "one.mp4")], "id string, video string")
    assert {(r["id"], r["video_id"]) for r in scoring.resolve_videos(labels, library).collect()} == {("a", "x2"), ("b", "x1")}
    with pytest.raises(PySparkException, match="no video three"):
        scoring.resolve_videos(spark.createDataFrame([("c", "three")], labels.schema), library).collect()


def test_a_file_key_changes_with_the_file(spark):
    rows = spark.createDataFrame([("p", 1, 5), ("p", 1, 5), ("p", 2, 5), ("p", 1, 6)], "path string, size long, modified long")
    keys = [r["k"] for r in rows.select(t.file_key(F.col("path"), F.col("size"), F.col("modified"), F.lit("m")).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and all(len(k) == 24 for k in keys)
