import math
import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions import intervals as iv
from spanlake.functions import text as tx
from spanlake.operators import ocr, retrieval
from spanlake.operators.joins import asof_join, overlap_join
from spanlake.plans import specs
from spanlake import schema


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_times_and_keys(spark):
    got = [one(spark, iv.format_timestamp(F.lit(float(t)))) for t in (5.9, 3599.99, 3661.2)]
    assert got == ["00:05", "59:59", "01:01:01"]
    assert one(spark, iv.format_timestamp_precise(F.lit(59.999))) == "00:60.00"
    key = one(spark, iv.interval_cache_key(F.lit("/a/b c!.mp4"), F.lit(1.0005), F.lit(2.0)))
    assert key.startswith("interval_b_c_") and key.endswith("_0000001000_0000002000")
    assert one(spark, iv.iou(F.lit(0.0), F.lit(10.0), F.lit(5.0), F.lit(15.0))) == pytest.approx(1 / 3)


def test_tokens_of_any_script(spark):
    assert one(spark, tx.tokenize(F.lit("Été, x_1 ÈTRE!"))) == ["été", "x_1", "ètre"]


def test_reading_similarity():
    assert tx.reading_similarity("AB", "ab") == 1 and tx.reading_similarity("AB", "AC") == 0 and tx.reading_similarity("", "x") == 0
    assert tx.normalized_ocr(" ﬁve\0  x ") == "five x"
    assert 0.7 < tx.reading_similarity("platform 9", "platform 8") < 1


def test_knn_prefers_the_best_view(spark):
    items = spark.createDataFrame([("a", [[1.0, 0.0], [1.0, 0.0]]), ("b", [[0.2, 0.98], [0.0, 1.0]])], "chunk_id string, views array<array<float>>")
    queries = spark.createDataFrame([(0, [0.0, 1.0])], "query_id int, qvec array<float>")
    got = retrieval.knn_views(queries, items, 2).orderBy("rank").collect()
    assert got[0]["chunk_id"] == "b" and got[0]["score"] == 1


def test_knn_in_blocks_gives_the_same(spark):
    rng = random.Random(1)
    items = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(30)], "chunk_id int, vec array<float>")
    queries = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(7)], "query_id int, qvec array<float>")
    rows = lambda d: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in d.collect())
    assert rows(retrieval.knn(queries, items, 3)) == rows(retrieval.knn(queries, items, 3, block=2))


def test_pooling_and_the_nearest_frame(spark):
    frames = [("v", float(t), 0, [1.0, 0.0, 0.0]) for t in range(10)] + [("v", float(t), 1, [0.0, 1.0, 1.0] if t in (2, 3) else [0.0, 0.0, 0.0]) for t in range(10)]
    frames = spark.createDataFrame(frames, "video_id string, t float, view int, vec array<float>")
    chunks = spark.createDataFrame([("v", "in", 2.0, 4.0), ("v", "out", 20.0, 22.0)], "video_id string, chunk_id string, start double, end double")
    got = {(r["chunk_id"], r["view"]): [round(x, 4) for x in r["vec"]] for r in retrieval.pool_intervals(chunks, frames).collect()}
    assert got == {("in", 0): [1, 0, 0], ("in", 1): [0, 0.7071, 0.7071], ("out", 0): [1, 0, 0], ("out", 1): [0, 0, 0]}


def test_bm25_against_the_formula(spark):
    docs = [(0, "red car red"), (1, "blue car"), (2, "green tree"), (3, None), (4, "red tree stands")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    queries = spark.createDataFrame([("q", "red car car"), ("none", "zebra")], "query_id string, query string")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.bm25_search(queries, df, 4).collect()}
    tokens = [(t or "").split() for _, t in docs]
    n, avgdl, terms = len(docs), sum(map(len, tokens)) / len(docs), {t for d in tokens for t in d}
    raw = {t: math.log(n - sum(t in d for d in tokens) + 0.5) - math.log(sum(t in d for d in tokens) + 0.5) for t in terms}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    want = sorted(((-sum(idf[q] * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for q in ("red", "car", "car") if q in d), i) for i, d in enumerate(tokens)))
    assert [got["q", k][0] for k in range(4)] == [i for _, i in want[:4]]
    assert got["q", 0][1] == pytest.approx(-want[0][0])
    assert [got["none", k] for k in range(4)] == [(i, 0.0) for i in range(4)]


def test_overlap_join_equals_nested_loops(spark):
    rng = random.Random(2)
    a = [(rng.choice("xy"), i, s := rng.uniform(0, 100), s + rng.uniform(0.1, 60)) for i in range(40)]
    c = [(rng.choice("xy"), i, s := rng.uniform(0, 100), s + rng.uniform(0.1, 9)) for i in range(40)]
    left = spark.createDataFrame(a, "k string, i int, start double, end double")
    right = spark.createDataFrame(c, "k string, j int, r_start double, r_end double")
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, ["k"], 10.0).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in c if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])
    outer = overlap_join(left, right.where("j < 0"), ["k"], 10.0, how="left").collect()
    assert len(outer) == 40 and all(r["j"] is None for r in outer)


def test_asof_join(spark):
    left = spark.createDataFrame([("u", 1, 5.0), ("u", 2, 0.5), ("w", 3, 9.0)], "k string, id int, t double")
    right = spark.createDataFrame([("u", 1.0, "a"), ("u", 5.0, "b"), ("u", 7.0, "c")], "k string, rt double, v string")
    assert {r["id"]: r["v"] for r in asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()} == {1: "b", 2: None, 3: None}


def test_transcript_windows_and_speech(spark):
    words = spark.createDataFrame([("v", 1.0, 2.0, "one"), ("v", 16.0, 17.0, "two")], "video_id string, start double, end double, word string")
    videos = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    got = {r["chunk_id"]: r["text"] for r in retrieval.transcript_windows(words, videos).collect()}
    assert got == {"transcript_000000": "one two", "transcript_000001": "two", "transcript_000002": ""}
    segments = spark.createDataFrame([("v", 0.0, 2.0, "hello"), ("v", 5.0, 9.0, " stop the car ")], "video_id string, start double, end double, text string")
    at = spark.createDataFrame([("v", 0, 4.0, 8.0)], "video_id string, interval_id int, start double, end double")
    assert [tuple(r)[2:] for r in retrieval.speech_between(at, segments).collect()] == [(1.0, 4.0, "stop the car")]


def test_hierarchy_blends_the_parents_score(spark):
    rows = [("v", "coarse", "c0", 0.0, 100.0, [1.0, 0.0]), ("v", "coarse", "c1", 100.0, 200.0, [0.0, 1.0]), ("v", "fine", "f0", 10.0, 20.0, [0.6, 0.8]), ("v", "fine", "f1", 110.0, 120.0, [0.6, 0.8])]
    chunks = spark.createDataFrame(rows, "video_id string, scale string, chunk_id string, start double, end double, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, qvec array<double>")
    got = [(r["chunk_id"], round(r["score"], 6)) for r in retrieval.hierarchical_search(queries, chunks, 2, ("coarse", "fine")).orderBy("rank").collect()]
    assert got == [("f0", 0.72), ("f1", 0.42)]
    order = [r["scale"] for r in retrieval.scale_order(chunks.withColumn("duration", F.col("end") - F.col("start"))).orderBy("level").collect()]
    assert order == ["coarse", "fine"]


PLAN = '{"executor": "%s", "evidence_predicates": [{"id": "a", "description": " red car ", "role": "target", "modalities": ["video", "smell"], "required": true, "importance": 3}, {"description": "RED CAR"}, {"description": "siren", "modalities": []}], "negative_evidence": [" ", "toy"], "ordering": [{"first": "a", "then": "evidence_2"}, {"first": "a", "then": "ghost"}, {"first": "a", "then": "a"}], "visual_queries": ["red car", "x"], "metadata_queries": [], "transcript_queries": ["said"], "weights": {"video": 2, "metadata": 1, "transcript_semantic": -5, "transcript_bm25": 1}, "target_event": "e"}'


def test_plan_cleaning_and_specs(spark):
    rows = spark.createDataFrame([("q", "find it", PLAN % "temporal_grounding"), ("t", "read it", PLAN % "visual_text_extraction")], "query_id string, query string, json string")
    plans = specs.clean_plan(rows.select("query_id", "query", F.from_json("json", schema.PLAN).alias("plan")))
    got = {r["query_id"]: r["plan"] for r in plans.collect()}
    assert [(p["id"], p["description"], p["modalities"], p["importance"]) for p in got["q"]["evidence_predicates"]] == [("a", "red car", ["video"], 1.0), ("evidence_2", "siren", ["video", "metadata"], 0.5)]
    assert [(r["first"], r["then"]) for r in got["q"]["ordering"]] == [("a", "evidence_2")]
    assert got["q"]["weights"].asDict() == {"video": 0.5, "metadata": 0.25, "transcript_semantic": 0.0, "transcript_bm25": 0.25}
    assert got["q"]["negative_evidence"] == ["toy"] and got["q"]["target_object"] == ""
    assert got["t"]["visual_queries"] == [] and got["t"]["target_object"] and sum(got["t"]["weights"]) == 0
    found = sorted((r["channel"], r["ranking"], r["query"], r["predicate_id"]) for r in specs.query_specs(plans).collect())
    assert found == [
        ("metadata", 0, "siren", "evidence_2"), ("negative", 0, "toy", "negative_0"), ("negative", 1, "toy", "negative_0"), ("transcript_bm25", 0, "said", "planner_query"),
        ("video", 0, "red car", "planner_query"), ("video", 1, "x", "planner_query"), ("video", 2, "siren", "evidence_2"),
    ]


def test_json_must_fit_the_schema(spark):
    rows = spark.createDataFrame([(t,) for t in ('{"ok": true}', '{"ok": "wrong"}', '{"ok": true, "more": 1}', "{", None)], "t string")
    assert [r["v_valid"] for r in schema.parse_json(rows, "t", "ok boolean", "v").collect()] == [True, False, False, False, False]


def test_search_options():
    assert specs.search_options(query=" a  b ")["query"] == "a b" and specs.search_options("quick", query="x")["max_candidates"] == 12
    for bad in ({"query": ""}, {"query": "x", "mode": "fast"}, {"query": "x", "max_candidates": 51}, {"query": "x", "min_confidence": 2}):
        with pytest.raises(ValueError):
            specs.search_options(**bad)


def test_consensus_and_entities():
    text, confidence = ocr.consensus([("PLATFORM 9", 0.9), ("platform 9", 0.5), ("EXIT", 0.95), (None, 1.0), ("platfrm 9", 0.4)])
    assert text == "PLATFORM 9" and confidence == pytest.approx(0.6)
    assert ocr.consensus([("", 1.0)]) == ("", 0.0)
    assert ocr.grouped_texts([("Exit", 0.5), ("EXIT", 0.7), ("Way out", 0.2), (" ", 1)]) == [("EXIT", 0.7, [0, 1]), ("Way out", 0.2, [2])]


def test_appearances_merge(spark):
    base = {"best_timestamp": 1.0, "readable": True, "target_description": "", "visual_evidence": ""}
    rows = [{"start": 0.0, "end": 2.0, "ocr_text": "EXIT", "confidence": 0.4} | base, {"start": 3.0, "end": 4.0, "ocr_text": "exit", "confidence": 0.9} | base, {"start": 9.0, "end": 10.0, "ocr_text": "exit", "confidence": 0.9} | base]
    got = ocr.merged_rows(rows)
    assert [(r["start"], r["end"], r["ocr_text"], r["observations"]) for r in got] == [(0.0, 4.0, "exit", 2), (9.0, 10.0, "exit", 1)]
    df = spark.createDataFrame([{"video_id": "v"} | r for r in rows])
    assert ocr.merge_appearances(df, ["video_id"]).count() == 2
