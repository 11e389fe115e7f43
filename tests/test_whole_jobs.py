"""Registered queries do the whole job: every query, interval and character that their tables hold."""

import random

import duckdb
import pytest

from spanlake import queries
from spanlake.operators import retrieval


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "conversations", "documents"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return con


def rows(frame, names):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in frame[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["knn_exact", "view_max", "hierarchical_search"])
def test_every_hundredth_vector_is_searched(spark, sf, duck, name):
    want = duck.execute(queries.SQL[name].replace("vec_id < 5", "vec_id % 100 = 0")).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert set(got["query_id"]) == {0, 100, 200, 300, 400}
    for x, y in zip(rows(got, sorted(want.columns)), rows(want, sorted(want.columns)), strict=True):
        assert all(u == v or u == pytest.approx(v, abs=2e-5) for u, v in zip(x, y, strict=True))


def test_views_and_hierarchy_in_blocks_give_the_same(spark):
    rng = random.Random(2)
    vec = lambda: [rng.random() for _ in range(4)]
    ask = spark.createDataFrame([(i, vec()) for i in range(7)], "query_id int, qvec array<double>")
    items = spark.createDataFrame([(i, [vec(), vec()]) for i in range(30)], "chunk_id int, views array<array<double>>")
    found = lambda d: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in d.collect())
    assert found(retrieval.knn_views(ask, items, 3)) == found(retrieval.knn_views(ask, items, 3, block=2))
    chunks = [("v", s, f"{s}{i}", i * w, (i + 1) * w, vec()) for s, w, n in (("coarse", 40.0, 3), ("fine", 4.0, 30)) for i in range(n)]
    chunks = spark.createDataFrame(chunks, "video_id string, scale string, chunk_id string, start double, end double, vec array<double>")
    search = lambda **x: found(retrieval.hierarchical_search(ask, chunks, 3, ("coarse", "fine"), **x))
    assert search() == search(block=2)


def test_search_text_holds_the_whole_document(spark, tmp_path):
    text = "Seven small boats left the old harbour early; nobody aboard knew what the lighthouse keeper had seen"
    spark.createDataFrame([(1, text, "en", "web"), (2, " !", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    people = "; ".join(text.lower().replace(";", "").split())
    got = [tuple(r) for r in queries.QUERIES["search_text"](spark, str(tmp_path)).collect()]
    assert got == [(1, f"Summary: {text}\nScene: web\nPeople: {people}\nSearch terms: en; web")]


def test_readings_are_whole_titles(spark, tmp_path):
    titles = ["Annual report of the harbour: boats", "Annual report of the harbour: lighthouse keepers and crews"]
    spark.createDataFrame([(i, f"<html><title>{t}</title></html>") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {name: [r.asDict() for r in queries.QUERIES[name](spark, str(tmp_path)).collect()] for name in ("ocr_consensus", "ocr_merge", "text_entities")}
    assert found["ocr_consensus"][0]["ocr_text"] in titles
    assert sorted(r["ocr_text"] for r in found["ocr_merge"]) == titles
    assert sorted(r["text"] for r in found["text_entities"]) == titles


def test_speech_is_looked_at_to_the_end(spark, tmp_path):
    turns = [(0, 0, "word " * 395), (0, 1, "late " * 50), (1, 0, "brief words")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["video_id"], r["interval_id"], r["turn"]): (r["from_second"], r["to_second"]) for r in queries.QUERIES["speech_overlap"](spark, str(tmp_path)).collect()}
    assert got == {(0, i, 0): (0, 25) for i in range(10)} | {(0, 10, 1): (0, 25), (0, 11, 1): (0, 5), (1, 0, 0): (0, 2)}
