"""Scores that differ in the last digit only: numbers of candidates must not hang on the order in which rows arrive."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_evidence import hits, videos

from spanlake import queries
from spanlake.operators import evidence as ev


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Recordings whose every hit comes 200 times, so that many bins saturate at the same scores. In the third, the first one's
    without its purchases, one of value 0 says that the truth lies in one of two such regions."""
    folder = tmp_path_factory.mktemp("crowded")
    rows = "SELECT event_id + k * 100000 AS event_id, ts, user_id{} AS user_id, event_type, value, props FROM '/root/testdata/sf0.1/events.parquet', range(200) t(k) WHERE "
    bare = rows.format(" + 10000") + "user_id = 172 AND event_type <> 'purchase'"
    truth = """SELECT -1, TIMESTAMP '2024-01-01' + INTERVAL 650 HOUR, 10172, 'purchase', 0.0, '{"k": 1}'"""
    duckdb.execute(f"COPY ({rows.format('')} user_id IN (172, 1467) UNION ALL {bare} UNION ALL {truth}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["candidate_islands", "iou_recall", "predicate_peaks", "window_score"])
def test_crowded_recordings_are_numbered_as_by_sql(spark, crowded, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{crowded}/events.parquet'")
    got, want = queries.QUERIES[name](spark, crowded).toPandas(), con.execute(queries.SQL[name]).df()
    names = sorted(want.columns)
    rows = lambda d: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in d[names].itertuples(index=False))
    assert rows(got) == rows(want)


def test_scores_are_the_same_to_the_last_digit_in_any_order(spark):
    rows = [("video", n % 3, n // 3, n * 0.37 % 9, n * 0.37 % 9 + 8, 1 / (n + 1), n % 10 / 10, None) for n in range(60)]
    found = [[r["score"] for r in ev.evidence_map(hits(spark, some).repartition(parts), videos(spark, 40), {"video": 0.4}).orderBy("bin_id").collect()] for some, parts in ((rows, 1), (rows[::-1], 7))]
    assert found[0] == found[1]


def test_shares_are_taken_as_written(spark):
    two = [("video", n, 0, 10.0 if n == 0 else 90.0, 18.0 if n == 0 else 99.0, 0.9, 0.14, None) for n in range(2)]
    best = ev.evidence_map(hits(spark, two), videos(spark, 40), {"video": 1.0}).agg(F.max("score")).first()[0]
    q = 1 - (1 - (0.55 + 0.45 * 0.14))
    assert best == 0.8 * q + 0.2 * q / 2


def test_rankings_longer_than_a_block_are_multiplied_whole(spark, monkeypatch):
    monkeypatch.setattr(ev, "BLOCK", 7)
    rows = spark.range(40).select(F.lit("v").alias("video_id"), F.lit("q").alias("query_id"), F.lit("video").alias("channel"), F.lit(0).alias("ranking"), F.col("id").cast("int").alias("rank"), F.lit(3).alias("bin_id"), F.lit(0.02).alias("calibrated"), F.lit(1.0).alias("importance"), F.lit(1.0).alias("overlap_fraction"))
    got = ev.noisy_or(rows).first()
    assert got["hits"] == 40 and got["q"] == pytest.approx(1 - 0.98**40, abs=1e-12)
