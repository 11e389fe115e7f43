"""Streaming forms of the timeline, as an extension: tumbling bins, sliding windows and islands over event time.

The watermark says how late a hit may come; later ones are dropped, which the batch operators never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bins(hits: DataFrame, size: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Noisy-or of contributions (video_id, channel, ts, contribution) by tumbling window."""
    return hits.withWatermark("ts", late).groupBy("video_id", "channel", F.window("ts", size).alias("w")).agg(
        (1 - F.product(1 - F.col("contribution"))).alias("q"), F.count("*").alias("hits")
    ).select("video_id", "channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "q", "hits")


def live_windows(words: DataFrame, size: str = "30 seconds", stride: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Texts of sliding windows of a word stream (video_id, ts, word)."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "word"))), lambda x: x["word"]), " ")
    return words.withWatermark("ts", late).groupBy("video_id", F.window("ts", size, stride).alias("w")).agg(said.alias("text")).select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "text")


def live_islands(bins: DataFrame, gap_seconds: float = 10.0, late: str = "1 minute") -> DataFrame:
    """Regions of strong bins (video_id, ts, length_seconds, score): a bin joins those that it follows within the gap."""
    gap = F.concat(F.format_string("%.3f", F.col("length_seconds") + gap_seconds), F.lit(" seconds"))
    return bins.withWatermark("ts", late).groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(
        F.max("score").alias("score"), F.sum("score").alias("evidence_mass"), F.count("*").alias("num_supporting_bins"), F.max("ts").alias("last")
    ).select("video_id", F.col("w.start").alias("start"), "last", "score", "evidence_mass", "num_supporting_bins")
