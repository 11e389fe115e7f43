"""The queries of the engine's operators over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import binding as b
from spanlake.functions import intervals as iv
from spanlake.functions import text as tx
from spanlake.functions import vectors as vc
from spanlake.operators import candidates as cd
from spanlake.operators import evidence as ev
from spanlake.operators import folds, ocr, refine, retrieval, scoring, windows
from spanlake.operators.joins import asof_join
from spanlake.plans import specs
from spanlake.sources.scratch import materialize
from spanlake.sources.tables import number_matches, pending

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = b.KEYS


def query(sql: str | None = None):
    """Register the function under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[iv.rounded(F.col(c), places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# DuckDB building blocks, each a list of common table expressions after the one before
HITS = """h AS (SELECT user_id AS video_id, event_id, CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'metadata' WHEN 'signup' THEN 'transcript_semantic'
 WHEN 'purchase' THEN 'transcript_bm25' ELSE 'negative' END AS channel, k % 4 AS ranking, k / 100::DOUBLE AS importance, value AS score, t AS s, least(t + 8, 720::DOUBLE) AS e
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS t FROM events)),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, channel, ranking ORDER BY score DESC, event_id) - 1 AS rank FROM h)"""
CALIBRATED = (
    HITS
    + """, c0 AS (SELECT *, max(score) OVER w AS top, min(score) OVER w AS low, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY video_id, channel, ranking)),
c AS (SELECT *, CASE WHEN top > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, score / top * (0.05::DOUBLE + 0.7::DOUBLE * exp(-rank / greatest(2::DOUBLE, least(12::DOUBLE, n * 0.1::DOUBLE))))
 + 0.25::DOUBLE * CASE WHEN top - low > 1e-12 THEN (score - low) / (top - low) ELSE 1 END)) ELSE 0 END AS calibrated FROM c0)"""
)
BINNED = (
    CALIBRATED
    + """, x AS (SELECT *, unnest(generate_series(CAST(floor(s / 2) AS BIGINT), least(359, CAST(floor(greatest(s, e - 1e-9) / 2) AS BIGINT)))) AS bin_id FROM c WHERE calibrated > 0 AND e > s),
b AS (SELECT *, (least(e, least(720::DOUBLE, bin_id * 2 + 2)) - greatest(s, bin_id * 2)) / 2::DOUBLE AS fraction FROM x)"""
)
NOISY = BINNED + ", q AS (SELECT video_id, channel, ranking, bin_id, 1 - product(1 - least(1::DOUBLE, calibrated * (0.55::DOUBLE + 0.45::DOUBLE * importance)) * sqrt(fraction)) AS q FROM b WHERE fraction > 0 GROUP BY ALL)"
MAPPED = (
    NOISY
    + """, nr AS (SELECT video_id, channel, count(DISTINCT ranking) AS n FROM r GROUP BY ALL),
m AS (SELECT q.video_id, q.channel, bin_id, 0.8::DOUBLE * max(q) + 0.2::DOUBLE * sum(q) / any_value(n) AS value, count(*) FILTER (q > 0.05) AS support FROM q JOIN nr USING (video_id, channel) GROUP BY ALL)"""
)
DENSE = (
    MAPPED
    + """, vb AS (SELECT video_id, channel, bin_id FROM (SELECT DISTINCT video_id, channel FROM m) CROSS JOIN (SELECT unnest(generate_series(0, 359)) AS bin_id)),
d AS (SELECT video_id, channel, bin_id, coalesce(value, 0) AS value, coalesce(support, 0) AS support FROM vb LEFT JOIN m USING (video_id, channel, bin_id)),
sm AS (SELECT video_id, channel, bin_id, support, (coalesce(lag(value) OVER w, 0) + 2 * value + coalesce(lead(value) OVER w, 0)) / CASE WHEN bin_id IN (0, 359) THEN 3::DOUBLE ELSE 4 END AS value FROM d WINDOW w AS (PARTITION BY video_id, channel ORDER BY bin_id))"""
)
EVIDENCE = (
    DENSE
    + """, ev AS (SELECT video_id, bin_id, bin_id * 2::DOUBLE AS s, bin_id * 2::DOUBLE + 2 AS e, greatest(0::DOUBLE, least(1::DOUBLE,
 sum(value * CASE channel WHEN 'video' THEN 0.4::DOUBLE WHEN 'metadata' THEN 0.3::DOUBLE WHEN 'transcript_semantic' THEN 0.2::DOUBLE WHEN 'transcript_bm25' THEN 0.1::DOUBLE ELSE -0.5::DOUBLE END))) AS score,
 sum(value) FILTER (channel = 'video') AS ch_video, sum(value) FILTER (channel = 'negative') AS ch_negative, CAST(sum(support) FILTER (channel = 'video') AS BIGINT) AS sup_video FROM sm GROUP BY video_id, bin_id)"""
)
REGIONS = (
    EVIDENCE
    + """, st AS (SELECT ev.* FROM ev JOIN (SELECT video_id, max(score) AS best FROM ev GROUP BY ALL) USING (video_id) WHERE best > 0 AND score >= least(best, greatest(0.02::DOUBLE, best * 0.05::DOUBLE))),
i0 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY video_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 1 ELSE 0 END AS new FROM st),
i1 AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY s) AS island FROM i0),
rg AS (SELECT video_id, greatest(0::DOUBLE, min(s) - 10) AS s, least(720::DOUBLE, max(e) + 10) AS e, max(score) AS score, sum(score) AS mass, count(*) AS bins FROM i1 GROUP BY video_id, island),
cand AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, mass DESC, bins DESC, s) - 1 AS candidate_id FROM rg)"""
)


@query("WITH g AS (SELECT c_custkey, abs(c_acctbal) / 10 + 1 AS d FROM customer), w AS (SELECT c_custkey, d, unnest(generate_series(0, CAST(greatest(0, ceil((d - 30) / 15)) AS BIGINT))) AS idx FROM g) "
       "SELECT c_custkey, idx, round(idx * 15::DOUBLE, 3) AS start, round(least(idx * 15::DOUBLE + 30, d), 3) AS \"end\" FROM w")
def win_generate(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.read(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") / 10 + 1).alias("duration"))
    return windows.generate_windows(rows, 30.0, 15.0).select("c_custkey", "idx", "start", "end")


CHUNKS = """rec AS (SELECT max(vec_id) * 4::DOUBLE + 8 AS d FROM embeddings), sc AS (SELECT * FROM (VALUES ('coarse', 120, 60), ('medium', 30, 15), ('fine', 8, 4)) AS t(scale, w, st)),
g AS (SELECT scale, w, st, d, unnest(generate_series(0, CAST(greatest(0, ceil((d - w) / st)) AS BIGINT))) AS idx FROM sc, rec),
ch AS (SELECT scale, idx, scale || '_' || lpad(idx::VARCHAR, 6, '0') AS chunk_id, round(idx * st::DOUBLE, 3) AS s, round(least(idx * st::DOUBLE + w, d), 3) AS e FROM g)"""


@query(f"WITH {CHUNKS} SELECT scale, idx, chunk_id, s AS start, e AS \"end\" FROM ch")
def win_multiscale(spark: SparkSession, sf: str) -> DataFrame:
    return windows.multiscale_chunks(b.recording(spark, sf)).select("scale", "idx", "chunk_id", "start", "end")


@query(f"WITH {CHUNKS} SELECT p.scale AS parent_scale, p.chunk_id AS parent_id, c.chunk_id AS child_id, round(least(p.e, c.e) - greatest(p.s, c.s), 9) AS overlap FROM ch p JOIN ch c ON p.s < c.e AND p.e > c.s AND (p.scale, c.scale) IN (('coarse', 'medium'), ('medium', 'fine'))")
def win_hierarchy_links(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieval.chunk_links(windows.multiscale_chunks(b.recording(spark, sf))).drop("video_id"))


@query(f"""WITH {CHUNKS}, l AS (SELECT p.chunk_id AS parent_id, c.chunk_id AS child_id, least(p.e, c.e) - greatest(p.s, c.s) AS overlap, CASE WHEN p.s <= (c.s + c.e) / 2 AND (c.s + c.e) / 2 <= p.e THEN 2 ELSE 3 END AS tier
 FROM ch p JOIN ch c ON p.s < c.e AND p.e > c.s AND (p.scale, c.scale) IN (('coarse', 'medium'), ('medium', 'fine'))), k AS (SELECT *, min(tier) OVER (PARTITION BY child_id) AS least_tier FROM l)
 SELECT parent_id, child_id, round(overlap, 9) AS overlap, tier, row_number() OVER (PARTITION BY child_id ORDER BY overlap DESC, parent_id) = 1 AS is_best FROM k WHERE tier = least_tier""")
def win_best_parents(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieval.best_parents(windows.multiscale_chunks(b.recording(spark, sf))).drop("video_id"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_quantity + l_discount * 1000 + 1 AS e FROM lineitem), n AS (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((e - s - 25) / 20)) AS BIGINT))) AS idx FROM g)
 SELECT l_orderkey, l_linenumber, idx, round(s + idx * 20::DOUBLE, 9) AS start, round(least(s + idx * 20::DOUBLE + 25, e), 9) AS \"end\" FROM n""")
def win_verifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_discount") * 1000 + 1).alias("end"))
    return _rounded(windows.verifier_windows(rows).select("l_orderkey", "l_linenumber", "idx", "start", "end"))


@query("""WITH g AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS t FROM events), p AS (SELECT event_id, greatest(0, t - 8) AS s FROM g UNION SELECT event_id, greatest(0, t - 4) FROM g)
 SELECT event_id, round(s, 6) AS probe_start, round(least(720, s + 8), 6) AS probe_end FROM p WHERE least(720, s + 8) - s >= 0.75""")
def win_boundary_probe(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.read(spark, sf, "events").select("event_id", b.hours().alias("estimate"), F.lit(720.0).alias("duration"))
    return windows.boundary_probes(rows, 8.0).select("event_id", "probe_start", "probe_end")


@query("""WITH g AS (SELECT o_orderkey, o_totalprice / 1000 AS s, o_totalprice / 1000 + 20 + o_orderkey % 50 AS e, greatest(12::DOUBLE, (20 + o_orderkey % 50) / 2::DOUBLE) AS w FROM orders),
 n AS (SELECT *, greatest(0.25::DOUBLE, w / 2) AS st, unnest(generate_series(0, CAST(ceil(greatest(0, e - s - w) / greatest(0.25::DOUBLE, w / 2) - 1e-9) AS BIGINT))) AS i FROM g)
 SELECT DISTINCT o_orderkey, round(greatest(s, least(s + i * st, e - w)), 9) AS start, round(least(e, greatest(s, least(s + i * st, e - w)) + w), 9) AS \"end\" FROM n""")
def win_child(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.read(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("s"), (F.col("o_totalprice") / 1000 + 20 + F.col("o_orderkey") % 50).alias("e"), F.greatest(F.lit(12.0), (20 + F.col("o_orderkey") % 50) / 2).alias("w"))
    return _rounded(rows.select("o_orderkey", F.explode(windows.child_windows(F.col("s"), F.col("e"), F.col("w"))).alias("c")).select("o_orderkey", "c.start", "c.end"))


@query(f"WITH {HITS} SELECT video_id, event_id, channel, ranking, CAST(rank AS INTEGER) AS rank, round(importance, 9) AS importance, round(score, 9) AS score, round(s, 9) AS start, round(e, 9) AS \"end\" FROM r")
def hits_bind(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(b.hits(spark, sf).select("video_id", "event_id", "channel", "ranking", "rank", "importance", "score", "start", "end"))


@query(f"WITH {CALIBRATED} SELECT video_id, event_id, round(calibrated, 9) AS calibrated FROM c")
def rank_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.calibrate(b.hits(spark, sf), KEYS).select("video_id", "event_id", "calibrated"))


def _binned(spark: SparkSession, sf: str) -> DataFrame:
    return ev.expand_bins(ev.calibrate(b.hits(spark, sf), KEYS).where("calibrated > 0").withColumn("duration", F.lit(b.DURATION)))


@query(f"WITH {BINNED} SELECT video_id, event_id, bin_id, round(fraction, 9) AS overlap_fraction FROM b WHERE fraction > 0")
def bin_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_binned(spark, sf).select("video_id", "event_id", "bin_id", "overlap_fraction"))


@query(f"WITH {NOISY} SELECT video_id, channel, ranking, bin_id, round(q, 9) AS q FROM q")
def noisy_or(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.noisy_or(_binned(spark, sf), KEYS).drop("hits"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    rankings = b.hits(spark, sf).groupBy(*KEYS, "channel").agg(F.countDistinct("ranking").alias("n_rankings"))
    return ev.channel_map(ev.noisy_or(_binned(spark, sf), KEYS), rankings, KEYS)


@query(f"WITH {MAPPED} SELECT video_id, channel, bin_id, round(value, 9) AS value, support FROM m")
def channel_map(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_mapped(spark, sf))


@query(f"WITH {DENSE} SELECT video_id, channel, bin_id, round(value, 9) AS value FROM sm WHERE value > 0")
def smooth(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.smooth(_mapped(spark, sf).select(*KEYS, "channel", "bin_id", "value", F.lit(360).alias("n_bins")), [*KEYS, "channel"])
    return _rounded(rows.where("value > 0").select(*KEYS, "channel", "bin_id", "value"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return ev.evidence_map(b.hits(spark, sf), b.videos(spark, sf), b.WEIGHTS, KEYS)


@query(f"WITH {EVIDENCE} SELECT video_id, bin_id, s AS start, e AS \"end\", round(score, 9) AS score, round(coalesce(ch_video, 0), 9) AS ch_video, round(coalesce(ch_negative, 0), 9) AS ch_negative, coalesce(sup_video, 0) AS sup_video FROM ev")
def evidence_map(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_evidence(spark, sf).select("video_id", "bin_id", "start", "end", "score", "ch_video", "ch_negative", "sup_video"))


@query(f"WITH {EVIDENCE} SELECT video_id, round(max(score), 9) AS peak FROM ev GROUP BY video_id")
def evidence_peak(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.evidence_peak(_evidence(spark, sf), KEYS))


@query(f"WITH {EVIDENCE}, t AS (SELECT video_id, round(score, 9) AS score, bin_id, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, bin_id) AS place FROM ev) SELECT video_id, bin_id, score, CAST(place AS INTEGER) AS place FROM t WHERE place <= 20")
def evidence_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ev.top_bins(_rounded(_evidence(spark, sf).select("video_id", "bin_id", "score")), 20, KEYS).select("video_id", "bin_id", "score", "place")


@query(f"WITH {EVIDENCE} SELECT video_id, CAST(bin_id // 4 AS BIGINT) AS bucket, min(s) AS start, max(e) AS \"end\", round(max(score), 9) AS score FROM ev GROUP BY video_id, bin_id // 4")
def downsample_max(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.downsample(_evidence(spark, sf).select("video_id", "bin_id", "start", "end", "score"), 100, KEYS))


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return cd.candidates_from_evidence(_evidence(spark, sf), b.videos(spark, sf), KEYS)


@query(f"WITH {REGIONS} SELECT video_id, candidate_id, round(s, 9) AS start, round(e, 9) AS \"end\", round(score, 9) AS score, round(mass, 9) AS evidence_mass, bins AS num_supporting_bins FROM cand")
def candidate_islands(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_regions(spark, sf).select("video_id", "candidate_id", "start", "end", "score", "evidence_mass", "num_supporting_bins"))


@query(f"""WITH {REGIONS}, met AS (SELECT cand.video_id, candidate_id, list(ev.score ORDER BY ev.score DESC) AS l FROM cand JOIN ev ON cand.video_id = ev.video_id AND ev.e > cand.s AND ev.s < cand.e GROUP BY ALL)
 SELECT video_id, candidate_id, round(0.55::DOUBLE * l[1] + 0.35::DOUBLE * list_avg(l[1:greatest(1, CAST(ceil(len(l) * 0.25::DOUBLE) AS BIGINT))]) + 0.1::DOUBLE * list_avg(l), 9) AS window_score, CAST(len(l) AS BIGINT) AS support_bins FROM met""")
def window_score(spark: SparkSession, sf: str) -> DataFrame:
    evidence = materialize(_evidence(spark, sf))
    regions = cd.candidates_from_evidence(evidence, b.videos(spark, sf), KEYS).select("video_id", "candidate_id", "start", "end")
    return _rounded(cd.window_scores(regions, evidence, KEYS).select("video_id", "candidate_id", "window_score", "support_bins"))


FUSED = HITS + """, fu AS (SELECT video_id, CAST(floor((s + e) / 2 / 5) AS BIGINT) AS bin_id, count(*) AS n, sum(CASE channel WHEN 'video' THEN 0.4::DOUBLE WHEN 'metadata' THEN 0.3::DOUBLE WHEN 'transcript_semantic' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END / (61 + rank)) AS score
 FROM r WHERE channel <> 'negative' GROUP BY ALL)"""


@query(f"WITH {FUSED} SELECT video_id, bin_id, round(score, 9) AS score, n AS num_hits FROM fu")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(cd.fuse_ranks(b.hits(spark, sf), b.WEIGHTS, KEYS).select("video_id", "bin_id", "score", "num_hits"))


@query(f"""WITH {FUSED}, st AS (SELECT fu.*, greatest(0::DOUBLE, bin_id * 5 - 2.5::DOUBLE) AS s, bin_id * 5 + 2.5::DOUBLE AS e FROM fu JOIN (SELECT video_id, max(score) AS best FROM fu GROUP BY ALL) USING (video_id) WHERE score >= best * 0.05::DOUBLE),
 i0 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY video_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 1 ELSE 0 END AS new FROM st), i1 AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY s) AS island FROM i0)
 SELECT video_id, round(greatest(0, min(s) - 10), 9) AS start, round(least(720, max(e) + 10), 9) AS \"end\", round(max(score), 9) AS score, round(sum(score), 9) AS fusion_mass, count(*) AS num_supporting_hits FROM i1 GROUP BY video_id, island""")
def rrf_cluster(spark: SparkSession, sf: str) -> DataFrame:
    fused = cd.fuse_ranks(b.hits(spark, sf), b.WEIGHTS, KEYS)
    return _rounded(cd.cluster_fused(fused, b.videos(spark, sf), KEYS).select("video_id", "start", "end", "score", "fusion_mass", "num_supporting_hits"))


PEAKS = REGIONS + """, pk0 AS (SELECT cand.video_id, candidate_id, cand.score AS cscore, cand.s AS cs, 'p' || ranking AS predicate_id, (r.s + r.e) / 2 AS peak, r.score AS hs,
 row_number() OVER (PARTITION BY cand.video_id, candidate_id, ranking ORDER BY r.score DESC, (r.s + r.e) / 2) AS rn FROM cand JOIN r ON cand.video_id = r.video_id AND (r.s + r.e) / 2 >= cand.s AND (r.s + r.e) / 2 < cand.e), pk AS (SELECT * FROM pk0 WHERE rn = 1)"""


@query(f"WITH {PEAKS} SELECT video_id, candidate_id, predicate_id, round(peak, 9) AS peak, round(hs, 9) AS peak_score FROM pk")
def predicate_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(cd.predicate_peaks(b.hits(spark, sf), _regions(spark, sf), KEYS))


@query(f"""WITH {PEAKS}, ru AS (SELECT * FROM (VALUES ('p0', 'p1'), ('p2', 'p3'), ('p1', 'p9')) AS t(a, z)), sc AS (SELECT x.video_id, x.candidate_id, count(*) FILTER (x.peak <= y.peak) AS sat, count(*) FILTER (x.peak > y.peak) AS vio
 FROM pk x JOIN ru ON x.predicate_id = a JOIN pk y ON y.video_id = x.video_id AND y.candidate_id = x.candidate_id AND y.predicate_id = z GROUP BY ALL)
 SELECT video_id, round(s, 9) AS start, round(score * pow(1.15::DOUBLE, coalesce(sat, 0)) * pow(0.75::DOUBLE, coalesce(vio, 0)), 7) AS score, coalesce(sat, 0) AS ordering_satisfied, coalesce(vio, 0) AS ordering_violated FROM cand LEFT JOIN sc USING (video_id, candidate_id)""")
def ordering_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("p0", "p1"), ("p2", "p3"), ("p1", "p9")], "first string, then string").join(b.videos(spark, sf).select("video_id"))
    out = cd.apply_ordering(materialize(_regions(spark, sf)), b.hits(spark, sf), rules, KEYS, KEYS)
    return _rounded(out.na.fill(0, ["ordering_satisfied", "ordering_violated"]).select("video_id", "start", F.round("score", 7).alias("score"), "ordering_satisfied", "ordering_violated"))


@query()
def refine_candidates(spark: SparkSession, sf: str) -> DataFrame:
    evidence = materialize(_evidence(spark, sf))
    regions = cd.candidates_from_evidence(evidence, b.videos(spark, sf), KEYS)
    out = refine.refine_candidates(regions, evidence, b.videos(spark, sf), KEYS)
    return _rounded(out.select("video_id", "candidate_id", "recursive_root_id", "recursive_depth", "start", "end", "score", "recursive_support_bins"))


DETECTED = HITS + ", dt AS (SELECT video_id, event_id, s, least(e + ranking, 720::DOUBLE) AS e, score AS confidence, channel FROM r)"
SAME_ACTOR = "(k.c = d[1].c OR starts_with(k.c, 'transcript') AND starts_with(d[1].c, 'transcript'))"
FOLD = """, l AS (SELECT video_id, list({{'n': event_id, 's': s, 'e': e, 'c': channel}} ORDER BY confidence DESC, s, e) AS a FROM dt GROUP BY video_id),
 k AS (SELECT video_id, list_reduce(list_transform(a, lambda x: [x]), lambda kept, d: CASE WHEN len(list_filter(kept, lambda k: (greatest(0::DOUBLE, least(k.e, d[1].e) - greatest(k.s, d[1].s)) / (greatest(k.e, d[1].e) - least(k.s, d[1].s)) >= {limit} AND {same}))) > 0 THEN kept ELSE list_concat(kept, d) END) AS kept FROM l)
 SELECT video_id, unnest(kept).n AS event_id FROM k"""


@query(f"WITH {DETECTED}" + FOLD.format(limit="0.55::DOUBLE", same=SAME_ACTOR))
def nms_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return folds.temporal_nms(b.detections(spark, sf), KEYS).select("video_id", "event_id")


@query(f"WITH {DETECTED}" + FOLD.format(limit="0.65::DOUBLE", same=SAME_ACTOR))
def dedupe_instances(spark: SparkSession, sf: str) -> DataFrame:
    return folds.deduplicate(b.detections(spark, sf), KEYS).select("video_id", "event_id")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) - 1 AS rank FROM s) SELECT query_id, item_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank < 50""")
def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    items = b.read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return _rounded(retrieval.knn(b.vector_queries(spark, sf), items, 50, "item_id").select("query_id", "item_id", "score", "rank"))


VIEWS = "v AS (SELECT vec_id, unnest(generate_series(0, 3)) AS view, embedding::DOUBLE[] AS x FROM embeddings)"


@query(f"""WITH {VIEWS}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, max(list_dot_product(v.x[view * 16 + 1:view * 16 + 16], q.embedding[1:16]::DOUBLE[])) AS score FROM v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q GROUP BY ALL),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) - 1 AS rank FROM s) SELECT query_id, item_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank < 20""")
def view_max(spark: SparkSession, sf: str) -> DataFrame:
    views = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    items = b.read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), views.alias("views"))
    queries = b.vector_queries(spark, sf).select("query_id", F.slice("qvec", 1, 16).alias("qvec"))
    return _rounded(retrieval.knn_views(queries, items, 20, "item_id").select("query_id", "item_id", "score", "rank"))


POOLED = CHUNKS + """, fr AS (SELECT vec_id * 4::DOUBLE AS t, unnest(generate_series(1, 64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
 me AS (SELECT scale, chunk_id, s, e, d, avg(x) AS x FROM ch JOIN fr ON t >= s AND t < e GROUP BY ALL), no AS (SELECT chunk_id, sqrt(sum(x * x)) AS n FROM me GROUP BY ALL), po AS (SELECT scale, chunk_id, s, e, d, x / n AS x FROM me JOIN no USING (chunk_id))"""


@query(f"WITH {POOLED} SELECT chunk_id, round(x, 9) AS x0 FROM po WHERE d = 1")
def pool_interval(spark: SparkSession, sf: str) -> DataFrame:
    chunks = windows.multiscale_chunks(b.recording(spark, sf))
    pooled = retrieval.pool_intervals(chunks, b.frames(spark, sf))
    return _rounded(pooled.select("chunk_id", F.element_at("vec", 1).alias("x0")))


@query("""WITH c AS (SELECT vec_id AS i, vec_id * 4 + 1.5::DOUBLE AS s, vec_id * 4 + 2.5::DOUBLE AS e FROM embeddings), n AS (SELECT c.i, v.vec_id, row_number() OVER (PARTITION BY c.i ORDER BY abs(v.vec_id * 4 - (s + e) / 2), v.vec_id) AS rn, v.embedding[1]::DOUBLE / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS x
 FROM c JOIN embeddings v ON abs(v.vec_id * 4 - (s + e) / 2) <= 8) SELECT CAST(i AS VARCHAR) AS chunk_id, round(x, 9) AS x0 FROM n WHERE rn = 1""")
def nearest_frame_fallback(spark: SparkSession, sf: str) -> DataFrame:
    chunks = b.read(spark, sf, "embeddings").select(F.lit("v0").alias("video_id"), F.col("vec_id").cast("string").alias("chunk_id"), (F.col("vec_id") * 4 + 1.5).alias("start"), (F.col("vec_id") * 4 + 2.5).alias("end"))
    return _rounded(retrieval.pool_intervals(chunks, b.frames(spark, sf)).select("chunk_id", F.element_at("vec", 1).alias("x0")))


_LEVEL = """, {b}0 AS (SELECT d.query_id, d.chunk_id, d.s, d.e, 0.7::DOUBLE * any_value(d.direct) + 0.3::DOUBLE * coalesce(max(p.score) FILTER (p.s - 1 <= (d.s + d.e) / 2 AND (d.s + d.e) / 2 <= p.e + 1), max(p.score)) AS score
 FROM di d JOIN {a} p ON p.query_id = d.query_id AND p.s - 1 < d.e AND p.e + 1 > d.s WHERE d.scale = '{b}' GROUP BY ALL),
 {b}_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM {b}0) WHERE rank < 24)"""


@query(f"""WITH {POOLED}, qv AS (SELECT vec_id AS query_id, unnest(generate_series(1, 64)) AS d, unnest(embedding)::DOUBLE AS y FROM embeddings WHERE vec_id % 100 = 0), di AS (SELECT query_id, scale, chunk_id, s, e, sum(x * y) AS direct FROM po JOIN qv USING (d) GROUP BY ALL),
 coarse_ AS (SELECT query_id, chunk_id, s, e, direct AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(direct, 9) DESC, chunk_id) - 1 AS rank FROM di WHERE scale = 'coarse') WHERE rank < 24)
 {_LEVEL.format(a="coarse_", b="medium")}{_LEVEL.format(a="medium_", b="fine")} SELECT query_id, chunk_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM fine_ WHERE rank < 5""")
def hierarchical_search(spark: SparkSession, sf: str) -> DataFrame:
    chunks = windows.multiscale_chunks(b.recording(spark, sf))
    vectors = retrieval.pool_intervals(chunks, b.frames(spark, sf)).select("video_id", "chunk_id", "vec")
    found = retrieval.hierarchical_search(b.vector_queries(spark, sf), materialize(chunks.join(vectors, ["video_id", "chunk_id"])), 5)
    return _rounded(found.select("query_id", "chunk_id", "score", "rank"))


TOKENS = r"tk AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY ALL)"
IDF = TOKENS + """, nd AS (SELECT count(*) AS n FROM documents), al AS (SELECT sum(tf) / (SELECT n FROM nd)::DOUBLE AS avgdl FROM tf), df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 ra AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, nd), me AS MATERIALIZED (SELECT avg(raw) AS mean FROM ra), idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM ra, me)"""


@query(f"WITH {TOKENS} SELECT doc_id, sum(tf)::BIGINT AS n_tokens, count(*) AS n_terms FROM tf GROUP BY doc_id")
def tokenise(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.term_counts(b.read(spark, sf, "documents")).groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))


@query(f"WITH {IDF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.read(spark, sf, "documents")
    return _rounded(retrieval.bm25_stats(retrieval.term_counts(docs), docs)[0])


@query(rf"""WITH {IDF}, qt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
 sc AS (SELECT item_id, doc_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), al GROUP BY ALL),
 t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM sc) SELECT item_id AS query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank < 10""")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    queries = b.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _rounded(retrieval.bm25_search(queries, b.read(spark, sf, "documents"), 10).select("query_id", "doc_id", "score", "rank"), 5)


WORDS = r"""tu AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM conversations), ta AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tu),
 wo AS (SELECT conv_id, turn, base + unnest(generate_series(1, len(w))) - 1 AS s, unnest(w) AS word FROM ta)"""


@query(f"""WITH {WORDS}, du AS (SELECT conv_id, count(*)::DOUBLE AS d FROM wo GROUP BY ALL), g AS (SELECT conv_id, d, unnest(generate_series(0, CAST(greatest(0, ceil((d - 30) / 15)) AS BIGINT))) AS idx FROM du)
 SELECT g.conv_id AS video_id, 'transcript_' || lpad(idx::VARCHAR, 6, '0') AS chunk_id, idx * 15::DOUBLE AS start, least(idx * 15::DOUBLE + 30, d) AS \"end\", string_agg(word, ' ' ORDER BY s) AS text FROM g JOIN wo ON wo.conv_id = g.conv_id AND s < least(idx * 15 + 30, d) AND s + 1 > idx * 15 GROUP BY ALL""")
def transcript_windows(spark: SparkSession, sf: str) -> DataFrame:
    words = b.words(spark, sf)
    return retrieval.transcript_windows(words.drop("turn"), words.groupBy("video_id").agg(F.count("*").cast("double").alias("duration")))


@query(f"""WITH {WORDS}, sg AS (SELECT conv_id, turn, min(s)::DOUBLE AS s, max(s) + 1::DOUBLE AS e FROM wo GROUP BY ALL), iv AS (SELECT conv_id, unnest(generate_series(0, CAST(ceil(max(e) / 40) AS BIGINT) - 1)) AS interval_id FROM sg GROUP BY conv_id)
 SELECT sg.conv_id AS video_id, CAST(interval_id AS INTEGER) AS interval_id, turn, greatest(s, interval_id * 40) - interval_id * 40::DOUBLE AS from_second, least(e, interval_id * 40 + 25) - interval_id * 40::DOUBLE AS to_second FROM sg JOIN iv ON sg.conv_id = iv.conv_id AND s < interval_id * 40 + 25 AND e > interval_id * 40""")
def speech_overlap(spark: SparkSession, sf: str) -> DataFrame:
    segments = b.words(spark, sf).groupBy("video_id", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("text", F.col("turn").cast("string"))
    lengths = segments.groupBy("video_id").agg(F.max("end").alias("duration"))
    marks = lengths.select("video_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / 40).cast("int") - 1)).alias("interval_id")).withColumns({"start": F.col("interval_id") * 40.0, "end": F.col("interval_id") * 40.0 + 25})
    return retrieval.speech_between(marks, segments).select("video_id", "interval_id", F.col("text").cast("long").alias("turn"), "from_second", "to_second")


@query("""WITH v AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'view') SELECT p.event_id, v.event_id AS view_id, round(v.value, 9) AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_bin(spark: SparkSession, sf: str) -> DataFrame:
    e = b.read(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.round("value", 9).alias("view_value"))
    return asof_join(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), views, ["user_id"], "ts", "view_ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query(r"""SELECT doc_id, 'Summary: ' || text || chr(10) || 'Scene: ' || source || chr(10) || 'People: ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), '; ') || chr(10) || 'Search terms: ' || lang || '; ' || source AS search_text FROM documents WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) > 0""")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.tokenize(F.col("text"))
    none = F.array().cast("array<string>")
    scene = {"summary": F.col("text"), "scene": F.col("source"), "people": tokens, "objects": none, "search_terms": F.array("lang", "source")}
    return b.read(spark, sf, "documents").where(F.size(tokens) > 0).select("doc_id", tx.scene_text(scene).alias("search_text"))


@query(r"SELECT page_id, regexp_replace(upper(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), 'ß', 'ss')), '[^\p{L}\p{N}]', '', 'g') AS key, regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]', '', 'g') AS answer FROM pages")
def ocr_key(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return b.read(spark, sf, "pages").select("page_id", tx.comparison_key(title).alias("key"), tx.answer_key(title).alias("answer"))


@query(f"""WITH {REGIONS}, la AS (SELECT video_id, min(s) AS ts, min(s) + 40 AS te FROM h WHERE channel = 'transcript_bm25' GROUP BY ALL), sc AS (SELECT la.video_id, max(round(io, 3)) AS best, arg_min(round(io, 3), candidate_id) AS top1, min(candidate_id) FILTER (io = mx) + 1 AS rank FROM
 (SELECT *, max(io) OVER (PARTITION BY video_id) AS mx FROM (SELECT la.video_id, candidate_id, CASE WHEN greatest(e, te) > least(s, ts) THEN greatest(0, least(e, te) - greatest(s, ts)) / (greatest(e, te) - least(s, ts)) ELSE 0 END AS io FROM la JOIN cand USING (video_id))) la GROUP BY ALL)
 SELECT la.video_id AS id, coalesce(best, 0) AS best_iou, coalesce(top1, 0) AS top1_iou, rank AS best_rank, coalesce(best, 0) >= 0.3::DOUBLE AS hit_03, coalesce(best, 0) >= 0.5::DOUBLE AS hit_05 FROM la LEFT JOIN sc USING (video_id)""")
def iou_recall(spark: SparkSession, sf: str) -> DataFrame:
    truth = b.hits(spark, sf).where("channel = 'transcript_bm25'").groupBy(F.col("video_id").alias("id")).agg(F.min("start").alias("true_start"), (F.min("start") + 40).alias("true_end")).withColumn("true_text", F.lit(None).cast("string"))
    found = _regions(spark, sf).select(F.col("video_id").alias("id"), F.col("candidate_id").alias("match_id"), "start", "end", F.lit(None).cast("string").alias("text"))
    return scoring.score_rows(truth, found).select("id", "best_iou", "top1_iou", "best_rank", "hit_03", "hit_05")


@query("SELECT source, count(*) AS count, count(*) FILTER (quality = 1) AS correct, round(avg(quality::DOUBLE), 3) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY source")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.read(spark, sf, "labels").join(b.read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    none = {"true_text": F.lit(None).cast("string"), "seconds": F.lit(0.0), "best_iou": F.lit(0.0), "hit_03": F.lit(False), "hit_05": F.lit(False), "text_exact": F.lit(False)}
    return scoring.summarize(rows.withColumn("correct", F.col("quality") == 1).withColumns(none), "source").select("source", "count", "correct", "accuracy")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return pending(b.read(spark, sf, "documents").select("doc_id"), b.read(spark, sf, "labels"), ["doc_id"])


@query(r"""WITH s AS (SELECT source, doc_id AS position, trim(coalesce(text, '')) AS q, (doc_id % 7) / 7::DOUBLE AS importance FROM documents), f AS (SELECT * FROM s WHERE q <> ''), r AS (SELECT *, min(position) OVER (PARTITION BY source, lower(q)) AS p, row_number() OVER (PARTITION BY source, lower(q) ORDER BY importance DESC, position) AS rn FROM f)
 SELECT source, p AS position, q AS query, round(importance, 9) AS importance FROM r WHERE rn = 1""")
def spec_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.read(spark, sf, "documents").select("source", F.col("doc_id").alias("position"), F.col("text").alias("query"), (F.col("doc_id") % 7 / 7).alias("importance"))
    return _rounded(specs.dedupe_specs(rows.where("query is not null"), ["source"]).select("source", "position", "query", "importance"))


@query("""WITH w AS (SELECT p_partkey, greatest(0, p_size - 25)::DOUBLE AS a, greatest(0, p_partkey % 5 - 2)::DOUBLE AS c, 0::DOUBLE AS d, greatest(0, p_partkey % 3 - 1)::DOUBLE AS f FROM part)
 SELECT p_partkey, round(CASE WHEN a + c + d + f > 0 THEN a / (a + c + d + f) ELSE 0.5 END, 9) AS video, round(CASE WHEN a + c + d + f > 0 THEN c / (a + c + d + f) ELSE 0.5 END, 9) AS metadata, round(CASE WHEN a + c + d + f > 0 THEN f / (a + c + d + f) ELSE 0 END, 9) AS transcript_bm25 FROM w""")
def weight_normalise(spark: SparkSession, sf: str) -> DataFrame:
    w = specs.normalize_weights({"video": F.col("p_size") - 25, "metadata": F.col("p_partkey") % 5 - 2, "transcript_semantic": F.lit(0), "transcript_bm25": F.col("p_partkey") % 3 - 1})
    return _rounded(b.read(spark, sf, "part").select("p_partkey", *[w[k].alias(k) for k in ("video", "metadata", "transcript_bm25")]))


@query("SELECT o_orderkey, o_custkey % 6 AS a, o_orderkey % 6 AS z FROM orders WHERE o_custkey % 6 < 4 AND o_orderkey % 6 < 4 AND o_custkey % 6 <> o_orderkey % 6")
def ordering_rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.struct(F.concat(F.lit("p"), F.col("o_custkey") % 6).alias("first"), F.concat(F.lit("p"), F.col("o_orderkey") % 6).alias("then"))
    rows = b.read(spark, sf, "orders").select("o_orderkey", F.explode(specs.clean_rules(F.array(rule), F.array(*[F.lit(f"p{i}") for i in range(4)]))).alias("r"))
    number = lambda c: F.substring(c, 2, 9).cast("long")
    return rows.select("o_orderkey", number("r.first").alias("a"), number("r.then").alias("z"))


@query(f"""WITH {DETECTED}, n AS (SELECT *, s * 10 AS s10, row_number() OVER (PARTITION BY video_id ORDER BY s, e, event_id) - 1 AS match_id FROM dt) SELECT video_id, event_id, match_id, CASE WHEN s10 >= 3600 THEN printf('%02d:', CAST(floor(s10 / 3600) AS INTEGER)) ELSE '' END || printf('%02d:%02d', CAST(floor(s10 % 3600 / 60) AS INTEGER), CAST(floor(s10 % 60) AS INTEGER)) AS shown FROM n""")
def match_format(spark: SparkSession, sf: str) -> DataFrame:
    return number_matches(b.detections(spark, sf), KEYS, "event_id").select("video_id", "event_id", "match_id", iv.format_timestamp(F.col("start") * 10).alias("shown"))


@query("SELECT item_id, substr(sha1(text), 1, 10) AS query_folder FROM benchmark")
def query_hash(spark: SparkSession, sf: str) -> DataFrame:
    return b.read(spark, sf, "benchmark").select("item_id", iv.query_folder(F.col("text")).alias("query_folder"))


@query("WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(x, x)), 9) AS norm, round(x[1] / sqrt(list_dot_product(x, x)), 9) AS x0 FROM d")
def vector_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(b.read(spark, sf, "embeddings").select("vec_id", vc.norm(F.col("embedding")).alias("norm"), F.element_at(vc.normalize(F.col("embedding")), 1).alias("x0")))


@query(f"""WITH {REGIONS}, la AS (SELECT candidate_id, s, e, video_id, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, s) AS rn FROM cand) SELECT video_id, round(s, 9) AS start, round(e, 9) AS \"end\", round(score, 9) AS confidence FROM la WHERE rn = 1""")
def best_mode(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators.verify import best_only

    return _rounded(best_only(cd.as_instances(_regions(spark, sf), KEYS), KEYS).select("video_id", "start", "end", "confidence"))


@query("SELECT scale, count(*) AS n_chunks, max(e) AS last FROM (SELECT * FROM (WITH " + CHUNKS + " SELECT * FROM ch)) GROUP BY scale")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.index_stats(windows.multiscale_chunks(b.recording(spark, sf))).select("scale", "n_chunks", "last")


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of pages as readings of on-screen text, forty pages a recording, ten seconds each."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return b.read(spark, sf, "pages").select(
        F.floor(F.col("page_id") / 40).cast("long").alias("video_id"), "page_id", (F.col("page_id") % 40 * 5.0).alias("start"), (F.col("page_id") % 40 * 5.0 + 8).alias("end"),
        (F.col("page_id") % 40 * 5.0 + 4).alias("best_timestamp"), title.alias("ocr_text"), F.lit(True).alias("readable"), (F.col("page_id") % 11 / 11).alias("confidence"), F.lit("").alias("target_description"), F.lit("").alias("visual_evidence"),
    )


@query()
def ocr_consensus(spark: SparkSession, sf: str) -> DataFrame:
    rows = _readings(spark, sf).withColumn("source", F.element_at(F.array(F.lit("crop"), F.lit("frame"), F.lit("coarse")), (F.col("page_id") % 3 + 1).cast("int")))
    return _rounded(ocr.consensus_text(rows, ["video_id"]))


@query()
def ocr_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ocr.merge_appearances(_readings(spark, sf), ["video_id"]).select("video_id", "start", "end", "ocr_text", "confidence", "observations"))


@query()
def text_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = _readings(spark, sf).withColumnRenamed("confidence", "ocr_confidence")
    return _rounded(ocr.text_entities(rows, ["video_id"], "page_id").select("video_id", "text", "confidence", "n_appearances"))


@query()
def search_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search without a model: evidence, regions, refinement, suppression, numbered matches."""
    from spanlake.engine import SearchSettings, search

    found = search(b.hits(spark, sf), b.videos(spark, sf), SearchSettings(weights=b.WEIGHTS), keys=KEYS)["matches"]
    return _rounded(found.select("video_id", "match_id", "start", "end", "confidence", "start_timestamp", "end_timestamp"))
