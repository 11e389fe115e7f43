"""Query plans and scene descriptions: what a model says about queries and chunks, checked, cleaned and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import schema
from spanlake.functions.text import scene_text
from spanlake.operators.verify import ModelBackend, json_answers
from spanlake.operators.views import scene_records
from spanlake.plans.specs import clean_plan
from spanlake.sources.tables import append_resumable, read_jsonl

_EVENTS = "important_events array<struct<start_seconds double, end_seconds double, description string"
#: A described scene as it is kept: the chunk, the model's fields, events also in the recording's time.
SCENE_RECORD = "video_id string, scale string, chunk_id string, start double, end double, " + schema.SCENE.replace(_EVENTS, f"{_EVENTS}, absolute_start double, absolute_end double")


def plan_queries(queries: DataFrame, backend: ModelBackend, attempts: int = 2, pause: float = 0.5) -> DataFrame:
    """queries (query_id, query) with a clean plan each; a query without a fitting answer has a null plan and an error."""
    asked = json_answers(queries.select("query_id", "query"), lambda rows: backend.plan(rows["query"]), schema.PLAN, "plan", schema.ENUMS, attempts, pause)
    return clean_plan(asked)


def describe_scenes(chunks: DataFrame, backend: ModelBackend, path: str, scale: str = "medium", most: int | None = None, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """Describe the chunks (video_id, scale, chunk_id, start, end) of a scale that the JSON lines at path lack and append them;
    returns the chunks that failed, with their errors. A run that was stopped goes on where it was."""
    wanted = chunks.where(F.col("scale") == scale).select("video_id", "scale", "chunk_id", "start", "end")

    def work(todo: DataFrame) -> DataFrame:
        said = json_answers(todo, backend.describe, schema.SCENE, "scene", attempts=attempts, pause=pause)
        return scene_records(said.select("video_id", "scale", "chunk_id", "start", "end", "scene.*", "error"))

    return append_resumable(wanted, path, ["video_id", "chunk_id"], work, most)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Described scenes with `text`, by which they are searched."""
    scenes = read_jsonl(spark, path, SCENE_RECORD)
    return scenes.withColumn("text", scene_text({name: F.col(name) for name in scenes.columns}, F.col("important_events")))
