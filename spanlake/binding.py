"""How the driver's tables stand for the engine's: users are recordings, their events hits; documents, turns and vectors the
texts, words and frames of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions.text import tokenize
from spanlake.operators.evidence import rank_hits

DURATION, HIT = 720.0, 8.0
CHANNEL_OF = {"view": "video", "click": "metadata", "signup": "transcript_semantic", "purchase": "transcript_bm25", "error": "negative"}
WEIGHTS = {"video": 0.4, "metadata": 0.3, "transcript_semantic": 0.2, "transcript_bm25": 0.1}
KEYS = ["video_id"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours() -> Column:
    """Hours since the events' first day, which stand for seconds of a recording."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), "event_type", "value", hours().alias("start"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    channel = F.create_map(*[F.lit(x) for kv in CHANNEL_OF.items() for x in kv])[F.col("event_type")]
    rows = e.select("video_id", "event_id", channel.alias("channel"), (F.col("k") % 4).alias("ranking"), F.concat(F.lit("p"), F.col("k") % 4).alias("predicate_id"), "start", F.least(F.col("start") + HIT, F.lit(DURATION)).alias("end"), F.col("value").alias("score"), (F.col("k") / 100).alias("importance"))
    return rank_hits(rows, KEYS, "event_id")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct().withColumn("duration", F.lit(DURATION))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping detections: each hit, up to four hours longer, its type as the actor."""
    h = hits(spark, sf_dir)
    return h.select("video_id", "event_id", "start", F.least(F.col("end") + F.col("ranking"), F.lit(DURATION)).alias("end"), F.col("score").alias("confidence"), F.concat("channel", F.lit(" actor")).alias("actor_description"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.lit("v0").alias("video_id"), (F.col("vec_id") * 4.0).alias("t"), F.lit(0).alias("view"), F.col("embedding").alias("vec"))


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").agg((F.max("vec_id") * 4.0 + 8).alias("duration")).select(F.lit("v0").alias("video_id"), "duration")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is a query, so the queries grow with the table."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's words, one a second, in order of its turns."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn", tokenize(F.coalesce("text", F.lit(""))).alias("w"))
    before = Window.partitionBy("video_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)))
    return placed.select("video_id", "turn", "at", F.posexplode("w").alias("pos", "word")).select("video_id", "turn", (F.col("at") + F.col("pos")).cast("double").alias("start"), (F.col("at") + F.col("pos") + 1).cast("double").alias("end"), "word")
