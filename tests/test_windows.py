import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake.operators import windows as w


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.select("start", "end").collect())


def durations(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "duration double")


def test_short_recordings_have_one_window(spark):
    assert spans(w.generate_windows(durations(spark, 12), 120.0, 60.0)) == [(0.0, 12.0)]
    assert spans(w.generate_windows(durations(spark, 1), 8.0, 4.0)) == [(0.0, 1.0)]


def test_leftover_is_dropped_only_when_short(spark):
    assert spans(w.generate_windows(durations(spark, 22), 10.0, 10.0)) == [(0.0, 10.0), (10.0, 20.0)]
    assert spans(w.generate_windows(durations(spark, 23), 10.0, 10.0)) == [(0.0, 10.0), (10.0, 20.0), (20.0, 23.0)]


def test_bad_arguments_are_errors(spark):
    for window, stride in ((8.0, 0.0), (-1.0, 4.0), (float("nan"), 4.0)):
        with pytest.raises(ValueError):
            w.generate_windows(durations(spark, 5), window, stride)
    with pytest.raises(Exception, match="positive and finite"):
        w.generate_windows(durations(spark, 0), 8.0, 4.0).collect()
    with pytest.raises(ValueError):
        w.scan_windows(durations(spark, 5), 30.0, 30.0)


def test_verifier_windows(spark):
    rows = spark.createDataFrame([(0.0, 60.0), (3.0, 20.0)], "start double, end double")
    assert spans(w.verifier_windows(rows)) == [(0.0, 25.0), (3.0, 20.0), (20.0, 45.0), (40.0, 60.0)]


def test_probes_keep_their_length_at_the_start(spark):
    rows = spark.createDataFrame([(1.0, 100.0), (50.0, 100.0), (0.0, 0.5)], "estimate double, duration double")
    got = sorted((r["estimate"], r["probe_start"], r["probe_end"]) for r in w.boundary_probes(rows, 8.0).collect())
    assert got == [(1.0, 0.0, 8.0), (50.0, 42.0, 50.0), (50.0, 46.0, 54.0)]


def test_child_windows_keep_their_width(spark):
    rows = spark.createDataFrame([(0.0, 30.0, 15.0), (0.0, 31.0, 15.0)], "s double, e double, c double")
    got = rows.select(w.child_windows(F.col("s"), F.col("e"), F.col("c")).alias("x")).collect()
    assert [tuple(x) for x in got[0].x] == [(0, 15), (7.5, 22.5), (15, 30)]
    assert [tuple(x) for x in got[1].x] == [(0, 15), (7.5, 22.5), (15, 30), (16, 31)]


def test_frame_and_sample_times(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 30.0)], "start double, end double, source_fps double")
    assert [(r["time"], r["frame_index"]) for r in w.frame_times(rows, 4.0).collect()] == [(0.0, 0), (0.25, 8), (0.5, 15), (0.75, 22), (1.0, 30)]
    assert [r["time"] for r in w.frame_times(rows, 4.0, 2).collect()] == [0.0, 1.0]
    assert [r["time"] for r in w.sample_times(rows, 2).collect()] == [0.25, 0.75]


def test_tiles(spark):
    got = w.tile_boxes(spark.createDataFrame([(48, 64)], "height int, width int")).orderBy("view").collect()
    assert len(got) == 5 and {(r["bottom"] - r["top"], r["right"] - r["left"]) for r in got[1:]} == {(24, 32)}


def test_refine_times_are_near_the_best(spark):
    rows = spark.createDataFrame([(10.0, 12.0, 11.0, 100.0)], "start double, end double, best double, duration double")
    got = [r["time"] for r in w.refine_times(rows).collect()]
    assert got == sorted(got) and len(got) == 14 and 11.0 in got and all(abs(t - 11) <= 1.25 for t in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0.5, 2000), min_size=1, max_size=5), st.sampled_from([(120.0, 60.0), (30.0, 15.0), (8.0, 4.0)]))
def test_windows_cover_the_recording(spark, lengths, scale):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "i int, duration double")
    by = {}
    for r in w.generate_windows(rows, *scale).collect():
        by.setdefault(r["i"], []).append((r["start"], r["end"]))
    for i, x in enumerate(lengths):
        mine = sorted(by[i])
        assert mine[0][0] == 0 and abs(mine[-1][1] - x) < 1e-3
        assert all(b[0] <= a[1] for a, b in zip(mine, mine[1:], strict=False))
