"""Media at the edge: speech, frame vectors and clips, made by callables that workers run and kept under a key of the file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import schema
from spanlake.functions.intervals import interval_cache_key
from spanlake.operators.verify import ModelBackend, json_answers
from spanlake.sources.scratch import materialize

CLIP = "video_id string, clip_id string, path string, start double, end double, clip_path string, error string"


def cached(rows: DataFrame, folder: str, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What make gives for rows, kept as Parquet in folder by key: only rows whose key the folder lacks are made, and appended.

    make keeps the column key, and gives each of its rows at least one row; another run finds them. The rows of these keys."""
    spark = rows.sparkSession
    there = _exists(spark, folder)
    todo = rows.join(spark.read.parquet(folder).select(key).distinct(), key, "left_anti") if there else rows
    make(todo).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(rows.select(key).distinct(), key, "left_semi")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def transcribe(files: DataFrame, backend: ModelBackend, language: str | None = None, attempts: int = 3, pause: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words, segments and failures of files (video_id, path). A file without sound has neither word nor segment."""
    asked = files.select("video_id", "path", F.lit(language).cast("string").alias("language"))
    said = json_answers(asked, backend.transcribe, schema.SPEECH, "speech", attempts=attempts, pause=pause)
    good = said.where("error is null")
    words = good.select("video_id", F.explode("speech.words").alias("w")).select("video_id", "w.*")
    segments = good.select("video_id", F.explode("speech.segments").alias("s")).select("video_id", "s.*").withColumn("text", F.trim("text"))
    return words, segments, said.where("error is not null").select("video_id", "path", "error")


def frame_vectors(frames: DataFrame, encode: Callable[[pd.DataFrame], pd.Series], batch: int = 8) -> DataFrame:
    """video_id, t, view, vec of frames (video_id, path, time): encode gives for each row of a batch its views' vectors, the whole
    frame first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for i in range(0, len(b), batch):
                some = b.iloc[i : i + batch]
                yield pd.DataFrame({"video_id": some["video_id"], "t": some["time"], "vecs": [[list(map(float, v)) for v in views] for views in encode(some)]})

    made = frames.select("video_id", "path", "time").mapInPandas(run, "video_id string, t double, vecs array<array<double>>")
    return made.select("video_id", "t", F.posexplode("vecs").alias("view", "vec"))


def write_clips(intervals: DataFrame, folder: str, cut: Callable[[str, float, float, str], None], most: int | None = None, prefix: str = "clip", ending: str = "mp4") -> DataFrame:
    """CLIP rows of intervals (video_id, clip_id, path, start, end[, rank]): cut(path, start, end, target) makes each clip once, in a
    shared folder under a name that its file and bounds decide, and must put a finished file there in one step, since a task
    that is lost runs again. most keeps the best ranks of each recording. Failures have an error and no path."""
    chosen = intervals if most is None else intervals.where(F.col("rank") < most)
    name = F.concat(F.lit(f"{folder.rstrip('/')}/"), interval_cache_key(F.col("path"), F.col("start"), F.col("end"), prefix), F.lit(f".{ending}"))
    rows = chosen.select("video_id", "clip_id", "path", "start", "end", name.alias("clip_path"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            errors: list[str | None] = []
            for r in b.itertuples():
                try:
                    if r.end <= r.start:
                        raise ValueError("a clip must be longer than 0 seconds")
                    cut(r.path, r.start, r.end, r.clip_path)
                    errors.append(None)
                except Exception as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(clip_path=[None if e else p for p, e in zip(b["clip_path"], errors, strict=True)], error=errors)

    return materialize(rows.mapInPandas(run, CLIP))
