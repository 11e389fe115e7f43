"""Accuracy of searches against labels: overlap of found and true intervals, texts, summaries, comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.intervals import iou, rounded
from spanlake.functions.text import answer_key


def score_rows(labels: DataFrame, matches: DataFrame, hit: float = 0.3, better: float = 0.5) -> DataFrame:
    """labels (id, true_start, true_end, true_text) with best_iou, top1_iou, best_rank (from 1, in the matches' own order),
    hit_03, hit_05, text_exact, text_contains, correct. matches: id, match_id, start, end, text."""
    both = labels.join(matches, "id", "left")
    value = F.when(F.col("true_text").isNull(), iou(F.col("start"), F.col("end"), F.col("true_start"), F.col("true_end")))
    truth, said = answer_key(F.col("true_text")), answer_key(F.col("text"))
    scored = both.withColumns({"__iou": rounded(value, 3), "__raw": value, "__exact": (said == truth) & (F.length(truth) > 0), "__in": said.contains(truth) & (F.length(truth) > 0)})
    each = scored.groupBy("id").agg(
        F.coalesce(F.max("__iou"), F.lit(0.0)).alias("best_iou"),
        F.coalesce(F.min_by("__iou", "match_id"), F.lit(0.0)).alias("top1_iou"),
        (F.max_by("match_id", F.struct("__raw", -F.col("match_id"))) + 1).alias("best_rank"),
        F.coalesce(F.max("__exact"), F.lit(False)).alias("text_exact"),
        F.coalesce(F.max("__in"), F.lit(False)).alias("text_contains"),
    )
    text = F.col("true_text").isNotNull()
    out = labels.join(each, "id").withColumns({"hit_03": F.col("best_iou") >= hit, "hit_05": F.col("best_iou") >= better})
    return out.withColumn("correct", F.when(text, F.col("text_exact")).otherwise(F.col("hit_03")))


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of the columns named: how many, accuracy, mean seconds, and over the rows they apply to mean overlap, recalls and exact texts."""
    span = F.col("true_text").isNull()
    share = lambda c, of=None: F.round(F.avg(F.when(of if of is not None else F.lit(True), F.col(c).cast("double"))), 3)
    return scored.groupBy(*by).agg(
        F.count("*").alias("count"), F.count_if("correct").alias("correct"), share("correct").alias("accuracy"), F.round(F.avg("seconds"), 1).alias("mean_seconds"),
        share("best_iou", span).alias("mean_iou"), share("hit_03", span).alias("recall_03"), share("hit_05", span).alias("recall_05"), share("text_exact", ~span).alias("text_exact"),
    )


def compare_runs(current: DataFrame, earlier: DataFrame, metric: str = "best_iou") -> DataFrame:
    """Each row of the current run with its change against the earlier one; new rows have none."""
    was = earlier.select("id", F.col(metric).alias("was"), F.col("correct").alias("was_correct"))
    return current.select("id", metric, "correct").join(was, "id", "left").withColumn("change", F.col(metric) - F.col("was"))


def resolve_videos(labels: DataFrame, library: DataFrame) -> DataFrame:
    """labels (id, video) with the library's video_id, found by id or by name; an id counts first. A video that the library
    lacks is an error once its row is read."""
    by_id = library.select(F.col("video_id").alias("__id"))
    w = Window.partitionBy("name").orderBy("video_id")
    by_name = library.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("name", F.col("video_id").alias("__named"))
    joined = labels.join(by_id, F.col("video") == F.col("__id"), "left").join(by_name, F.col("video") == F.col("name"), "left")
    lost = F.raise_error(F.concat(F.lit("the library has no video "), F.coalesce("video", F.lit("(null)"))))
    return joined.withColumn("video_id", F.coalesce("__id", "__named", lost)).drop("__id", "__named", "name")


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and the last chunk's end of each video and scale."""
    return chunks.groupBy("video_id", "scale").agg(F.count("*").alias("n_chunks"), F.max("end").alias("last"))


def funnel(stages: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys and, by stage, how many rows of it each query has in each recording."""
    counted = [rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, rows in stages.items()]
    return reduce(DataFrame.unionByName, counted).groupBy(*keys).pivot("stage", list(stages)).agg(F.first("n")).na.fill(0)
