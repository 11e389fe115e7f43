"""Channels: exact vector search, the hierarchical search over scales, BM25, and the runner over query specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.intervals import overlap
from spanlake.functions.text import tokenize
from spanlake.functions.vectors import dot, mean_vectors, normalize, view_score
from spanlake.operators.joins import asof_join, overlap_join
from spanlake.sources.scratch import materialize

#: Fixed values of the ranking function: saturation, length share, floor of negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries are the small side of a search; up to so many are broadcast, more are searched in blocks.
QUERY_BLOCK = 10_000
#: Query words up to which they are sent to the documents' terms.
BROADCAST_TERMS = 500_000


def _top(rows: DataFrame, by: list[str], k: int, order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < max(1, k))


def _query_blocks(queries: DataFrame, block: int):
    """queries in parts of at most about `block` rows, each small enough to send to every task."""
    n = queries.count()
    parts = -(-n // block)
    if parts <= 1:
        yield F.broadcast(queries)
    else:
        for i in range(parts):
            yield F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i))


def knn(queries: DataFrame, items: DataFrame, k: int, item_id: str = "chunk_id", block: int = QUERY_BLOCK) -> DataFrame:
    """The k best items (item_id, vec) of each query (query_id, qvec) by cosine: query_id, item_id, score, rank.

    The items stay where they are; each block of queries goes to them, and each task keeps its k best before the shuffle."""
    unit = items.select(item_id, normalize(F.col("vec")).alias("vec"))
    found = None
    for part in _query_blocks(queries.select("query_id", normalize(F.col("qvec")).alias("qvec")), block):
        scored = unit.crossJoin(part).select("query_id", item_id, dot(F.col("vec"), F.col("qvec")).alias("score"))
        top = _top(scored, ["query_id"], k, [F.desc(F.round("score", 9)), item_id])
        found = top if found is None else found.unionByName(top)
    return found if found is not None else _top(unit.crossJoin(queries).select("query_id", item_id, F.lit(0.0).alias("score")), ["query_id"], k, [item_id])


def knn_views(queries: DataFrame, items: DataFrame, k: int, item_id: str = "chunk_id", block: int = QUERY_BLOCK) -> DataFrame:
    """As knn, for items with an array of view vectors (views): the best view counts."""
    found = None
    for part in _query_blocks(queries, block):
        scored = items.crossJoin(part).select("query_id", item_id, view_score(F.col("views"), F.col("qvec")).alias("score"))
        top = _top(scored, ["query_id"], k, [F.desc(F.round("score", 9)), item_id])
        found = top if found is None else found.unionByName(top)
    return found


def pool_intervals(chunks: DataFrame, frames: DataFrame, cell: float = 60.0) -> DataFrame:
    """chunks (video_id, chunk_id, start, end) with one vector a view: the unit mean of the frames (video_id, t, view, vec)
    in [start, end); a chunk without a frame takes the frame nearest to its middle, the earlier of two."""
    points = frames.select("video_id", F.col("t").cast("double").alias("t"), "view", "vec").withColumn("__e", F.col("t") + F.lit(1e-9))
    inside = overlap_join(chunks.select("video_id", "chunk_id", "start", "end"), points, ["video_id"], cell, ("start", "end"), ("t", "__e")).where("t >= start and t < end")
    pooled = mean_vectors(inside, ["video_id", "chunk_id", "view"], "vec")
    empty = chunks.join(inside.select("video_id", "chunk_id").distinct(), ["video_id", "chunk_id"], "left_anti")
    times = frames.select("video_id", F.col("t").cast("double").alias("t")).distinct()
    middle = (F.col("start") + F.col("end")) / 2
    # the frame before the middle and, with time reversed, the one after it
    asked = empty.select("video_id", "chunk_id", middle.alias("m"), (-middle).alias("w"))
    sides = asof_join(asof_join(asked, times.withColumn("t0", F.col("t")), ["video_id"], "m", "t", ["t0"]).drop("t"), times.select("video_id", (-F.col("t")).alias("r"), F.col("t").alias("t1")), ["video_id"], "w", "r", ["t1"])
    earlier = F.col("t1").isNull() | (F.col("m") - F.col("t0") <= F.col("t1") - F.col("m"))
    nearest = sides.select("video_id", "chunk_id", F.when(F.col("t0").isNotNull() & earlier, F.col("t0")).otherwise(F.col("t1")).alias("t")).where("t is not null")
    fallback = nearest.join(frames.select("video_id", F.col("t").cast("double").alias("t"), "view", "vec"), ["video_id", "t"]).select("video_id", "chunk_id", "view", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return pooled.unionByName(fallback).withColumn("vec", normalize(F.col("vec")))


def chunk_links(chunks: DataFrame, scales: tuple[str, ...] = ("coarse", "medium", "fine")) -> DataFrame:
    """Every pair of overlapping chunks of neighbouring scales: video_id, parent_scale, parent_id, child_id, overlap."""
    found = None
    for upper, lower in zip(scales, scales[1:], strict=False):
        parents = chunks.where(F.col("scale") == upper).select("video_id", F.col("chunk_id").alias("parent_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        children = chunks.where(F.col("scale") == lower).select("video_id", F.col("chunk_id").alias("child_id"), "start", "end")
        pairs = overlap_join(children, parents, ["video_id"], 120.0, ("start", "end"), ("p_start", "p_end"))
        pairs = pairs.select("video_id", F.lit(upper).alias("parent_scale"), "parent_id", "child_id", overlap(F.col("start"), F.col("end"), F.col("p_start"), F.col("p_end")).alias("overlap"))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def best_parents(chunks: DataFrame, scales: tuple[str, ...] = ("coarse", "medium", "fine")) -> DataFrame:
    """Each child's parents: explicit ones (parent_ids) that exist, else those that hold its centre, else all that overlap;
    is_best marks the one with the longest common part, the first of equals."""
    links = chunk_links(chunks, scales)
    child = chunks.select("video_id", F.col("chunk_id").alias("child_id"), ((F.col("start") + F.col("end")) / 2).alias("centre"), *(["parent_ids"] if "parent_ids" in chunks.columns else []))
    parent = chunks.select("video_id", F.col("chunk_id").alias("parent_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    known = links.join(child, ["video_id", "child_id"]).join(parent, ["video_id", "parent_id"])
    explicit = F.array_contains("parent_ids", F.col("parent_id")) if "parent_ids" in chunks.columns else F.lit(False)
    tier = F.when(F.coalesce(explicit, F.lit(False)), 1).when((F.col("p_start") <= F.col("centre")) & (F.col("centre") <= F.col("p_end")), 2).otherwise(3)
    w = Window.partitionBy("video_id", "child_id")
    ranked = known.withColumn("tier", tier).withColumn("__least", F.min("tier").over(w)).where("tier = __least")
    place = F.row_number().over(w.orderBy(F.desc("overlap"), "parent_id"))
    return ranked.withColumn("is_best", place == 1).select("video_id", "parent_id", "child_id", "overlap", "tier", "is_best")


def scale_order(chunks: DataFrame) -> DataFrame:
    """Scales from coarse to fine: by median of the durations above 0, then by name, both descending."""
    length = F.greatest(F.lit(0.0), F.coalesce("duration", F.col("end") - F.col("start")))
    medians = chunks.withColumn("__l", length).groupBy("scale").agg(F.coalesce(F.expr("percentile(CASE WHEN __l > 0 THEN __l END, 0.5)"), F.lit(0.0)).alias("median_duration"))
    return medians.withColumn("level", (F.row_number().over(Window.orderBy(F.desc("median_duration"), F.desc("scale"))) - 1).cast("long"))


def hierarchical_search(
    queries: DataFrame, chunks: DataFrame, k: int, scales: tuple[str, ...] = ("coarse", "medium", "fine"), context: float = 0.3, padding: float = 1.0, multiplier: int = 4, least_beam: int = 24, block: int = QUERY_BLOCK
) -> DataFrame:
    """Beam search from coarse to fine: query_id, video_id, chunk_id, score, rank over chunks (video_id, scale, chunk_id, start,
    end, views or vec). A finer chunk's score is (1-context) x its own + context x its best parent's in the beam; parents are
    those that it names (parent_ids, if there is such a column), else those that hold its centre, or else those that overlap it, both padded. A scale where no chunk has a parent in the beam
    is searched whole with no context. Queries are searched in blocks."""
    found = None
    for part in _query_blocks(queries, block):
        best = _beam_search(part, chunks, k, scales, context, padding, multiplier, least_beam)
        found = best if found is None else found.unionByName(best)
    return found


def _beam_search(queries: DataFrame, chunks: DataFrame, k: int, scales: tuple[str, ...], context: float, padding: float, multiplier: int, least_beam: int) -> DataFrame:
    """hierarchical_search of queries that are few enough to send to every task."""
    context = min(0.95, max(0.0, context))
    score = view_score(F.col("views"), F.col("qvec")) if "views" in chunks.columns else dot(F.col("vec"), F.col("qvec"))
    # a beam never exceeds its scale, and k is clipped to the output scale before the beam is set
    total = chunks.where(F.col("scale") == scales[-1]).groupBy("video_id").agg(F.count("*").alias("total"))
    wanted = F.least(F.lit(max(1, k)), F.col("total"))
    beam = F.greatest(F.lit(least_beam), multiplier * wanted)
    by = ["query_id", "video_id"]

    def direct(scale: str) -> DataFrame:
        return chunks.where(F.col("scale") == scale).crossJoin(queries).select(*by, "chunk_id", "start", "end", score.alias("direct"), *(["parent_ids"] if explicit else []))

    def keep(rows: DataFrame, most: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "chunk_id")
        return rows.join(total, "video_id").withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most).drop("total")

    explicit = "parent_ids" in chunks.columns
    held = keep(direct(scales[0]).withColumn("score", F.col("direct")), beam)
    for scale in scales[1:]:
        held = materialize(held)
        parents = held.select(*by, F.col("chunk_id").alias("p_id"), (F.col("start") - padding).alias("p_start"), (F.col("end") + padding).alias("p_end"), F.col("score").alias("p_score"))
        own = direct(scale)
        pairs = overlap_join(own, parents, by, 120.0, ("start", "end"), ("p_start", "p_end"))
        named = F.lit(False)
        if explicit:  # parents that a chunk names count wherever they lie
            told = own.withColumn("p_id", F.explode("parent_ids")).join(parents, [*by, "p_id"]).withColumn("__told", F.lit(True))
            pairs = pairs.withColumn("__told", F.lit(False)).unionByName(told)
            named = F.col("__told")
        centre = (F.col("start") + F.col("end")) / 2
        holds = (F.col("p_start") <= centre) & (centre <= F.col("p_end"))
        best = pairs.groupBy(*by, "chunk_id", "start", "end", "direct").agg(F.coalesce(F.max(F.when(named, F.col("p_score"))), F.max(F.when(holds, F.col("p_score"))), F.max("p_score")).alias("parent"))
        blended = best.select(*by, "chunk_id", "start", "end", ((1 - context) * F.col("direct") + context * F.col("parent")).alias("score"))
        orphaned = own.join(best.select(*by).distinct(), by, "left_anti").select(*by, "chunk_id", "start", "end", ((1 - context) * F.col("direct")).alias("score"))
        held = keep(blended.unionByName(orphaned), F.greatest(wanted, beam))
    return held.where(F.col("rank") < k).select(*by, "chunk_id", "start", "end", "score", "rank")


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """tf of each term of each document: doc_id, term, tf."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25_stats(tf: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n, avgdl); documents without terms count; negative idf are a quarter of the mean idf."""
    corpus = docs.agg(F.count(doc_id).alias("n")).crossJoin(tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus.select("n")))
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))
    return raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")), corpus


def bm25_search(queries: DataFrame, docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", tf: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query (query_id, query): query_id, doc_id, score, rank. A repeated query word counts as
    often; documents with no query word have score 0 and fill a short ranking, least ids first."""
    tf = materialize(term_counts(docs, doc_id, text)) if tf is None else tf
    idf, corpus = bm25_stats(tf, docs, doc_id)
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    words = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = materialize(words.join(idf, "term"))
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else wanted
    met = tf.join(wanted, "term").join(lengths, "doc_id").crossJoin(F.broadcast(corpus.select("avgdl")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = met.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    # a ranking shorter than k lacks at most k more: the 2k least ids hold as many documents that don't match
    first = docs.select(F.col(doc_id).alias("doc_id")).distinct().orderBy("doc_id").limit(2 * k)
    short = scored.groupBy("query_id").agg(F.count("*").alias("__n")).where(F.col("__n") < k).select("query_id")
    none = queries.select("query_id").join(words.join(tf.select("term").distinct(), "term", "left_semi").select("query_id").distinct(), "query_id", "left_anti")
    blank = short.unionByName(none).crossJoin(F.broadcast(first)).join(scored, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return _top(scored.unionByName(blank), ["query_id"], k, [F.desc(F.round("score", 9)), "doc_id"])


def transcript_windows(words: DataFrame, videos: DataFrame, window: float = 30.0, stride: float = 15.0) -> DataFrame:
    """video_id, chunk_id, start, end, text: the words (video_id, start, end, word) that overlap each window, in order of
    their start; windows without words stay, with an empty text."""
    from spanlake.operators.windows import generate_windows

    grid = generate_windows(videos.select("video_id", "duration"), window, stride).drop("duration")
    spoken = words.select("video_id", F.col("start").alias("w_start"), F.col("end").alias("w_end"), "word")
    met = overlap_join(grid, spoken, ["video_id"], window, ("start", "end"), ("w_start", "w_end"))
    said = met.groupBy("video_id", "idx").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_start", "w_end", "word"))), lambda x: x["word"]), " ")).alias("text"))
    full = grid.join(said, ["video_id", "idx"], "left")
    return full.select("video_id", F.format_string("transcript_%06d", "idx").alias("chunk_id"), "start", "end", F.coalesce("text", F.lit("")).alias("text"))


def spoken(windows: DataFrame) -> DataFrame:
    """Transcript windows with any text; the others are not indexed, and numbers stay as they were."""
    return windows.where(F.trim("text") != "")


def speech_between(intervals: DataFrame, segments: DataFrame, cell: float = 30.0) -> DataFrame:
    """intervals (video_id, interval_id, start, end) with the speech in them, times from the interval's start and clipped."""
    said = segments.select("video_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.trim("text").alias("text"))
    met = overlap_join(intervals.select("video_id", "interval_id", "start", "end"), said, ["video_id"], cell, ("start", "end"), ("s_start", "s_end"))
    return met.select("video_id", "interval_id", (F.greatest("s_start", "start") - F.col("start")).alias("from_second"), (F.least("s_end", "end") - F.col("start")).alias("to_second"), "text")
