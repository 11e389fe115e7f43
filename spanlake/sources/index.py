"""The persisted indexes: chunks of every scale with their pooled vectors and links, texts with vectors and term counts; searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import retrieval
from spanlake.operators.verify import ModelBackend, embed_texts
from spanlake.operators.windows import SCALES, multiscale_chunks
from spanlake.sources.scratch import materialize
from spanlake.sources.tables import load_index, write_index

#: Names that stand for all scales.
HIERARCHICAL = ("hierarchical", "multiscale", "multi", "all")


def embed_scale(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """chunks with `views`, one unit vector a view in the order of the views (frames: video_id, t, view, vec)."""
    pooled = retrieval.pool_intervals(chunks, frames).groupBy("video_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("view", "vec"))).alias("v"))
    return chunks.join(pooled, ["video_id", "chunk_id"]).withColumn("views", F.transform("v", lambda x: x["vec"])).drop("v")


def build_index(videos: DataFrame, frames: DataFrame, folder: str, signature: str, scales: dict[str, tuple[float, float]] = SCALES) -> None:
    """Chunks with vectors and links of all scales, written to a folder that is whole once its marker is there."""
    chunks = multiscale_chunks(videos, scales)
    write_index({"chunks": embed_scale(chunks, frames), "links": retrieval.chunk_links(chunks, tuple(scales))}, folder, signature)


def saved_scales(spark: SparkSession, folder: str) -> list[str]:
    """Scales of which a finished index has chunks, from coarse to fine."""
    return [r["scale"] for r in retrieval.scale_order(load_index(spark, folder)["chunks"]).orderBy("level").collect()]


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int, scale: str | None = None, signature: str | None = None) -> DataFrame:
    """The k best chunks of each query (query_id, qvec): of one scale by exact comparison, or by beam search over all scales
    if the scale is one of HIERARCHICAL or None. Adds retrieval_mode, retrieval_output_scale and retrieval_scale_order."""
    chunks = load_index(spark, folder, signature)["chunks"]
    order = saved_scales(spark, folder)
    if scale is None or scale in HIERARCHICAL:
        found, mode, output = retrieval.hierarchical_search(queries, chunks, k, tuple(order)), "hierarchical", order[-1]
    elif scale in order:
        found, mode, output = retrieval.knn_views(queries, chunks.where(F.col("scale") == scale), k).where(F.col("rank") < k), "single_scale", scale
        order = [scale]
    else:
        raise ValueError(f"{folder} has no scale {scale}, only {', '.join(order)}")
    return found.withColumns({"retrieval_mode": F.lit(mode), "retrieval_output_scale": F.lit(output), "retrieval_scale_order": F.array(*map(F.lit, order))})


def build_text_index(rows: DataFrame, backend: ModelBackend, folder: str, signature: str) -> None:
    """Texts (video_id, chunk_id, start, end, text) of scenes or transcript windows with their vectors and term counts, so that
    neither is made again for a search. Blank texts are not indexed; the others keep their ids."""
    texts = materialize(retrieval.spoken(rows).select("video_id", "chunk_id", "start", "end", "text").withColumn("doc_id", F.concat_ws("/", "video_id", "chunk_id")))
    write_index({"texts": embed_texts(texts, backend), "terms": retrieval.term_counts(texts)}, folder, signature)


def search_texts(spark: SparkSession, folder: str, queries: DataFrame, k: int, backend: ModelBackend | None = None, signature: str | None = None) -> DataFrame:
    """The k best texts of each query (query_id, query) with video_id, chunk_id, start, end: by meaning if there is a model for
    the query's vector, else by words."""
    tables = load_index(spark, folder, signature)
    texts = tables["texts"]
    if backend is None:
        found = retrieval.bm25_search(queries, texts.select("doc_id", "text"), k, tf=tables["terms"])
    else:
        asked = embed_texts(queries.select("query_id", "query"), backend, "query", "query", "qvec")
        found = retrieval.knn(materialize(asked), texts, k, "doc_id")
    return found.join(texts.select("doc_id", "video_id", "chunk_id", "start", "end", "text"), "doc_id").drop("doc_id")
