"""From ranked hits to a timeline: calibration, noisy-or over bins, channels, smoothing, and the weighted score.

Keys (video_id, query_id by default) run through everything; all steps are aggregations on them and the bin, so one long
video or one common query is spread over the bins' tasks. Products and sums are taken in a fixed order: candidates whose
scores differ in the last digit only would else be numbered as partitions happen to arrive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["video_id", "query_id"]
CHANNELS = ("video", "metadata", "transcript_semantic", "transcript_bm25")
NEGATIVE = "negative"
#: How much negative evidence takes away; what a hit keeps at importance 0 and gains with it; the channel mix
#: of peak and mean (both parts as written: 1 - 0.8 is not 0.2 in doubles); ranks multiplied at a time.
NEGATIVE_WEIGHT, LEAST_FACTOR, MORE_FACTOR, PEAK_SHARE, MEAN_SHARE, SUPPORTED, BLOCK = 0.5, 0.55, 0.45, 0.8, 0.2, 0.05, 4096


def rank_hits(hits: DataFrame, keys: list[str] = KEYS, tie: str = "chunk_id") -> DataFrame:
    """rank: place of each hit in its ranking, from 0, by score; ties by the column given."""
    w = Window.partitionBy(*keys, "channel", "ranking").orderBy(F.desc("score"), tie)
    return hits.withColumn("rank", F.row_number().over(w) - 1)


def calibrate(hits: DataFrame, keys: list[str] = KEYS, pad_to: int | None = None) -> DataFrame:
    """calibrated: each hit's score in [0, 1] from its place in its ranking and its share of the best and of the range.

    pad_to: the ranking counts as filled up to so many rows of score 0."""
    w = Window.partitionBy(*keys, "channel", "ranking")
    raw = F.greatest(F.lit(0.0), F.col("score"))
    n, low = F.count("*").over(w), F.min(raw).over(w)
    if pad_to:
        low, n = F.when(n < pad_to, F.lit(0.0)).otherwise(low), F.greatest(n, F.lit(pad_to))
    out = hits.withColumns({"__raw": raw, "__top": F.max(raw).over(w), "__low": low, "__n": n})
    spread = F.col("__top") - F.col("__low")
    within = F.when(spread > 1e-12, (F.col("__raw") - F.col("__low")) / spread).otherwise(1.0)
    decay = F.exp(-F.col("rank") / F.greatest(F.lit(2.0), F.least(F.lit(12.0), F.col("__n") * F.lit(0.1))))
    score = F.col("__raw") / F.col("__top") * (F.lit(0.05) + F.lit(0.70) * decay) + F.lit(0.25) * within
    out = out.withColumn("calibrated", F.when(F.col("__top") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0))
    return out.drop("__raw", "__top", "__low", "__n")


def expand_bins(hits: DataFrame, size: float = 2.0) -> DataFrame:
    """hits (start, end, duration) x the bins that they overlap: bin_id, overlap_fraction of the bin."""
    size = max(0.1, float(size))
    s, e = F.greatest(F.lit(0.0), F.col("start")), F.least(F.col("duration"), F.col("end"))
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / size)).cast("long")
    lo, hi = F.floor(s / size).cast("long"), F.least(n - 1, F.floor(F.greatest(s, e - 1e-9) / size).cast("long"))
    out = hits.withColumns({"__s": s, "__e": e, "__lo": lo, "__hi": hi}).where((F.col("__e") > F.col("__s")) & (F.col("__hi") >= F.col("__lo")))
    out = out.withColumn("bin_id", F.explode(F.sequence("__lo", "__hi")))
    b0 = F.col("bin_id") * F.lit(size)
    b1 = F.least(F.col("duration"), b0 + size)
    common = F.least("__e", b1) - F.greatest("__s", b0)
    return out.withColumn("overlap_fraction", common / F.greatest(F.lit(1e-9), b1 - b0)).where(F.col("overlap_fraction") > 0).drop("__s", "__e", "__lo", "__hi")


def _in_order(values: Column) -> Column:
    """Product of the values p of an array of structs, in the structs' order."""
    return F.aggregate(F.array_sort(values), F.lit(1.0), lambda product, x: product * x["p"])


def noisy_or(binned: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row for each ranking and bin: q = 1 - product(1 - contribution), by rank in blocks, however many hits there are."""
    contribution = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated") * (LEAST_FACTOR + MORE_FACTOR * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance")))))) * F.sqrt("overlap_fraction")
    by = [*keys, "channel", "ranking", "bin_id"]
    blocks = binned.groupBy(*by, F.floor(F.col("rank") / BLOCK).alias("__block")).agg(_in_order(F.collect_list(F.struct("rank", (1 - contribution).alias("p")))).alias("p"), F.count("*").alias("hits"))
    return blocks.groupBy(*by).agg((1 - _in_order(F.collect_list(F.struct("__block", "p")))).alias("q"), F.sum("hits").alias("hits"))


def channel_map(ranked: DataFrame, rankings: DataFrame, keys: list[str] = KEYS, *keep: str) -> DataFrame:
    """Of noisy_or's rows: value = 0.8 peak + 0.2 mean over the channel's rankings, support = rankings above 0.05.

    rankings: keys, channel, n_rankings, counting every ranking that has a hit, wherever it lies, and the columns of keep."""
    sums = ranked.groupBy(*keys, "channel", "bin_id").agg(F.max("q").alias("peak"), F.aggregate(F.array_sort(F.collect_list(F.struct("ranking", "q"))), F.lit(0.0), lambda total, x: total + x["q"]).alias("total"), F.count(F.when(F.col("q") > SUPPORTED, 1)).alias("support"))
    value = PEAK_SHARE * F.col("peak") + MEAN_SHARE * F.col("total") / F.col("n_rankings")
    return sums.join(rankings, [*keys, "channel"]).select(*keys, "channel", *keep, "bin_id", value.alias("value"), "support")


def smooth(series: DataFrame, keys: list[str], value: str = "value", n: str = "n_bins", radius: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Triangular mean of a sparse series over bins 0..n-1: each bin gives radius+1-distance parts to its neighbours, and
    each neighbour divides by the parts that reach it. A series needs no window and no dense form for that.

    carry: columns that stay in their own bins."""
    radius = max(0, int(radius))
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(radius + 1 - abs(d))).alias("w")) for d in range(-radius, radius + 1)])
    given = series.withColumn("__o", F.explode(offsets)).withColumn("__to", F.col("bin_id") + F.col("__o.d"))
    given = given.where((F.col("__to") >= 0) & (F.col("__to") < F.col(n)))
    own = [F.sum(F.when(F.col("__o.d") == 0, F.col(c)).otherwise(0)).alias(c) for c in carry]
    # each neighbour gives one number, so these sums are exact in any order, and adding them up goes by place
    near = [F.sum(F.when(F.col("__o.d") == d, F.col("__o.w") * F.col(value)).otherwise(0.0)).alias(f"__{radius + d}") for d in range(-radius, radius + 1)]
    sums = given.groupBy(*keys, n, F.col("__to").alias("bin_id")).agg(*near, *own)
    sums = sums.withColumn(value, reduce(Column.__add__, [F.col(f"__{i}") for i in range(2 * radius, -1, -1)])).drop(*[f"__{i}" for i in range(2 * radius + 1)])
    reach = reduce(Column.__add__, [F.when((F.col("bin_id") + d >= 0) & (F.col("bin_id") + d < F.col(n)), float(radius + 1 - abs(d))).otherwise(0.0) for d in range(-radius, radius + 1)])
    return sums.withColumn(value, F.col(value) / reach)


def bins_of(videos: DataFrame, keys: list[str], size: float = 2.0) -> DataFrame:
    """Every bin of each row of videos (keys, duration): bin_id, start, end, center, n_bins."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0.0), F.col("duration")) / size)).cast("long")
    grid = videos.select(*keys, "duration", n.alias("n_bins")).withColumn("bin_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)))
    end = F.least("duration", (F.col("bin_id") + 1) * F.lit(float(size)))
    return grid.withColumns({"start": F.col("bin_id") * F.lit(float(size)), "end": end}).withColumn("center", (F.col("start") + F.col("end")) / 2)


def evidence_map(hits: DataFrame, videos: DataFrame, weights: dict[str, float], keys: list[str] = KEYS, size: float = 2.0, smoothing: int = 1, pad_to: int | None = None) -> DataFrame:
    """The dense timeline of each row of videos (keys, duration): bin_id, start, end, center, score, a ch_ column for each
    channel and for the negative one, and a sup_ column for each channel.

    hits: keys, channel, ranking, rank, start, end, score, importance. Hits without a row in videos don't count."""
    size = max(0.1, float(size))
    mapped = (*CHANNELS, NEGATIVE)
    known = hits.where(F.col("channel").isin(*mapped)).join(videos.select(*keys, "duration"), keys)
    ranked = noisy_or(expand_bins(calibrate(known, keys, pad_to).where("calibrated > 0"), size), keys)
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / size)).cast("long").alias("n_bins")
    # counted before any hit is left out: a ranking whose hits all lie outside the bins is one of the mean's parts
    rankings = known.groupBy(*keys, "channel", n).agg(F.countDistinct("ranking").alias("n_rankings"))
    smoothed = smooth(channel_map(ranked, rankings, keys, "n_bins"), [*keys, "channel"], radius=smoothing, carry=("support",))
    wide = smoothed.groupBy(*keys, "bin_id").agg(
        *[F.sum(F.when(F.col("channel") == c, F.col("value"))).alias(f"ch_{c}") for c in mapped],
        *[F.sum(F.when(F.col("channel") == c, F.col("support"))).alias(f"sup_{c}") for c in CHANNELS],
    )
    names = [f"ch_{c}" for c in mapped] + [f"sup_{c}" for c in CHANNELS]
    dense = bins_of(videos, keys, size).join(wide, [*keys, "bin_id"], "left").na.fill(0, names)
    total = reduce(Column.__add__, [F.lit(max(0.0, float(weights.get(c, 0.0)))) * F.col(f"ch_{c}") for c in CHANNELS]) - NEGATIVE_WEIGHT * F.col(f"ch_{NEGATIVE}")
    return dense.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).select(*keys, "bin_id", "start", "end", "center", "score", *names)


def evidence_peak(evidence: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return evidence.groupBy(*keys).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("peak"))


def top_bins(evidence: DataFrame, k: int = 20, keys: list[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "bin_id")
    return evidence.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def downsample(evidence: DataFrame, limit: int = 720, keys: list[str] = KEYS) -> DataFrame:
    """At most so many rows a timeline: neighbouring bins as one with the first start, last end and the best values."""
    n = F.col("__n")
    step = F.ceil(n / limit).cast("long")
    counted = evidence.join(evidence.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    best = [c for c in evidence.columns if c == "score" or c.startswith(("ch_", "sup_"))]
    return counted.groupBy(*keys, F.floor(F.col("bin_id") / step).cast("long").alias("bucket")).agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.max(c).alias(c) for c in best])
