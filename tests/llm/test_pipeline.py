"""The pipeline's stages, one after another, against brute force on what each was given."""

import collections

import corpus_pipeline as p
import pytest
from test_operators import brute_components, check_shards

from spanlake.llm import op8_mixing, op9_decontamination
from spanlake.llm.common import materialize


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in p.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf)))
    return docs


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[1:-1])
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]


def test_stages(spark, sf, steps):
    start, language, unique, clean, mixed, sharded = steps
    texts = {r["doc_id"]: r["text"] for r in start.collect()}
    assert set(ids(language)) == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    kept = {i for i, (_, _, k) in brute_components({i: texts[i] for i in ids(language)}).items() if k}
    assert sorted(ids(unique)) == sorted(kept)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert set(ids(clean)) == kept - {r["doc_id"] for r in op9_decontamination.leaks(unique, bench).collect()}
    copies = {r["doc_id"]: r["copies"] for r in op8_mixing.mix_documents(clean).collect()}
    assert collections.Counter(ids(mixed)) == collections.Counter({i: n for i, n in copies.items() if n})
    rows = sharded.collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(ids(mixed)) and all(r["text"] == texts[r["doc_id"]] for r in rows)
    check_shards(rows, max(r["size"] for r in rows))


def test_odd_rows_pass_through(spark, sf):
    from test_operators import DOCS, ODD

    docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in ODD], DOCS)
    for n, (_, stage) in enumerate(p.STAGES):
        assert stage(spark, docs.where("1 = 0"), sf).count() == 0
        out = stage(spark, docs, sf)
        assert n == len(p.STAGES) - 1 or out.columns == docs.columns
        assert out.count() >= 0
