"""Rounded columns are the SQL's to the last digit, without a tolerance."""

import duckdb

from spanlake import queries
from spanlake.operators import scoring


def differing(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.SQL[name]).df()
    rows = lambda d: set(d[sorted(want.columns)].itertuples(index=False, name=None))
    return rows(got) ^ rows(want)


def test_predicate_peaks_are_rounded_as_by_sql(spark):
    assert not differing(spark, "/root/testdata/sf0.01", "predicate_peaks")


def test_window_scores_are_rounded_as_by_sql(spark, tmp_path):
    rows = [(1, 480, "purchase", 41), (2, 960, "click", 91)]  # one hit a recording, whose score has a half at the tenth place
    values = ", ".join(f"({n}, TIMESTAMP '2024-01-01' + INTERVAL {minutes} MINUTE, {n}, '{kind}', 1.0::DOUBLE, '{{\"k\": {k}}}')" for n, minutes, kind, k in rows)
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert not differing(spark, str(tmp_path), "window_score")


def test_window_scores_take_shares_of_means_as_sql_does(spark, tmp_path):
    rows = [(1, 562, 22.68, 57), (2, 574, 27.69, 50)]  # one channel, so nothing hangs on the order in which SQL adds channels up
    values = ", ".join(f"({n}, TIMESTAMP '2024-01-01' + INTERVAL {hour} HOUR, 1, 'purchase', {value}::DOUBLE, '{{\"k\": {k}}}')" for n, hour, value, k in rows)
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert not differing(spark, str(tmp_path), "window_score")


def test_overlaps_are_rounded_as_by_sql(spark):
    ends = list(range(1, 2000, 2))
    labels = spark.createDataFrame([(k, 0.0, 2000.0, None) for k in ends], "id long, true_start double, true_end double, true_text string")
    matches = spark.createDataFrame([(k, 0, 0.0, float(k), None) for k in ends], "id long, match_id long, start double, end double, text string")
    got = {(r["id"], r["best_iou"], r["top1_iou"]) for r in scoring.score_rows(labels, matches).collect()}
    assert got == set(duckdb.execute("SELECT k, round(k / 2000::DOUBLE, 3), round(k / 2000::DOUBLE, 3) FROM range(1, 2000, 2) t(k)").fetchall())
