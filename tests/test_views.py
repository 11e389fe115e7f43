from pyspark.sql import functions as F

from spanlake.operators import views


def test_views(spark):
    rows = spark.createDataFrame([("Stop the CAR",), ("go",)], "text string")
    assert views.transcript_filter(rows, " car ").count() == 1 and views.transcript_filter(rows, " ").count() == 2
    assert rows.select(views.highlight(F.col("text"), "car").alias("x")).first()["x"] == "Stop the <mark>CAR</mark>"
    models = spark.createDataFrame([(["a", "b:1"], ["a:latest"])], "need array<string>, have array<string>")
    assert models.select(views.missing_models(F.col("need"), F.col("have")).alias("x")).first()["x"] == ["b:1"]
    index = spark.createDataFrame([(("m", 20, 6),), (("m", 20, 5),), (None,)], "i struct<scene_model string, frame_limit int, version int>")
    assert [r["x"] for r in index.select(views.index_outdated(F.col("i"), "m", 20, 6).alias("x")).collect()] == [False, True, None]
