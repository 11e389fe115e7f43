"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
#: The stages of a search without models, from ranks to matches, and the retrieval channels.
HEADLINE = ("rank_calibrate", "evidence_map", "candidate_islands", "refine_candidates", "nms_greedy", "search_matches", "rrf_cluster", "knn_exact", "hierarchical_search", "bm25_search", "transcript_windows")


def main() -> None:
    conf = {"spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"), "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g")}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from spanlake.queries import QUERIES

    spark.read.parquet(f"{SF}/events.parquet").count()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    videos = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF), "recordings": videos, "search_seconds_per_recording": round(seconds["search_matches"] / max(1, videos), 4)}
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
