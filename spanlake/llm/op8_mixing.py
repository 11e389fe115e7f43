"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source's target is its share of the budget by weight, held to twice its size, the excess going to the others by
weight. A source gives floor(target / size) complete epochs of all its documents first; the rest of its target is a
weighted sample without replacement: documents in ascending order of -ln(u) / quality, u hashed from the id and the text, as
far as their sizes' prefix sum goes; later documents of the last slice that still fit fill what is left, and at last one
that brings the source nearer to its target. Documents are taken whole.

No source is sorted as a whole. Rows with the same id and text are counted first, so they are one row however many they are.
Then the range of keys in which the prefix sum reaches the target is narrowed: quantiles of the keys in the range cut it
into SLICES slices, prefix sums over the slices say which one it is, until a source's slice has SLICE_ROWS rows at most.
The quantiles follow the keys, whatever the quality weights are. Only that slice is gathered, sorted and folded.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, ordered last;
repeated rows count each; ties of the key go by id, then text hash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.common import broadcast_under, materialize, table, with_row_key

#: The sources' weights, repeating; the budget and the limit as multiples of sizes.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST = 1.5, 2.0
#: Rows of a source that are sorted together at most; slices at a time; sources up to which their table is broadcast.
SLICE_ROWS, SLICES, BROADCAST_SOURCES = 4_000, 64, 10_000


def word_count(text: Column) -> Column:
    """Words: runs of anything but space and \\x09-\\x0D; their number is that of the places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1, the product of: the share of spaces that follow a plain word ending in a letter, comma or full stop, as prose
    has them; the share of lines that are no repeats; and for texts of under 50 words their length in relation to 50."""
    plain = F.regexp_count(text, F.lit(r"\p{L}[,.]?[ \n]"))
    breaks = F.regexp_count(text, F.lit(r"[ \n]"))
    lines = F.split(text, "\n")
    value = (plain + 1) / (breaks + 1) * F.size(F.array_distinct(lines)) / F.size(lines) * F.least(F.lit(1.0), (breaks + 1) / 50)
    return F.greatest(F.lit(0.05), F.coalesce(value, F.lit(0.05))).cast("double")


def targets(sizes: DataFrame, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes: source, source_size, rows. Adds weight and target: min(most * size, level * weight), the level such that
    targets add up to budget * all sizes. The sources by ascending size/weight are full up to the last one whose own level
    is within reach of what the fuller ones leave."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    fill = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    w = w.withColumns(
        {
            "all_size": F.sum("source_size").over(everything).cast("double") * budget,
            "full": F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)),
            "left": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    w = w.withColumn("own_level", (F.col("all_size") - F.col("full")) / F.col("left"))
    level = F.coalesce(F.min(F.when(F.col("own_level") < F.col("ratio"), F.struct("ratio", "own_level"))).over(everything)["own_level"], F.lit(float("inf")))
    return w.withColumn("target", F.least(F.col("source_size") * most, level * F.col("weight"))).select("source", "source_size", "rows", "target")


def _slice_of(keyed: DataFrame) -> DataFrame:
    """__source, __lo, __hi, __before: the range of keys in which each source's prefix sum reaches its __rest, and the sum below.

    A source has at most SLICE_ROWS rows in its range."""
    sources = materialize(keyed.where("__rest > 0").groupBy("__source").agg(F.count("*").alias("__n")))
    state = sources.select("__source", F.lit(float("-inf")).alias("__lo"), F.lit(float("inf")).alias("__hi"), F.lit(0).cast("long").alias("__before"), "__n")
    shares = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    while True:
        wide = state.where(F.col("__n") > SLICE_ROWS)
        if not wide.limit(1).count():
            return state.drop("__n")
        wide = broadcast_under(wide.drop("__n"), BROADCAST_SOURCES)
        same = F.col("__source").eqNullSafe(F.col("__of"))
        inside = keyed.join(wide.withColumnRenamed("__source", "__of"), same).drop("__of").where((F.col("__key") > F.col("__lo")) & (F.col("__key") <= F.col("__hi")))
        cuts = inside.groupBy(F.col("__source").alias("__of")).agg(F.percentile_approx("__key", shares, 2_000).alias("__cuts"))
        dealt = inside.join(broadcast_under(materialize(cuts), BROADCAST_SOURCES), same).drop("__of")
        dealt = dealt.withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < F.col("__key"))))
        sums = dealt.groupBy("__source", "__slice", "__lo", "__before", "__rest").agg(F.sum("__words").alias("__held"), F.max("__key").alias("__top"), F.count("*").alias("__n"))
        upto = Window.partitionBy("__source").orderBy("__slice")
        below = upto.rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumns({"__sum": F.col("__before") + F.coalesce(F.sum("__held").over(below), F.lit(0)), "__from": F.coalesce(F.max("__top").over(below), F.col("__lo"))})
        # the first slice that goes beyond the target; slices of size 0 before it change nothing
        here = sums.where(F.col("__sum") + F.col("__held") > F.col("__rest")).groupBy("__source").agg(F.min(F.struct("__slice", "__from", "__top", "__sum", "__n")).alias("s"))
        found = here.select("__source", F.col("s.__from").alias("__lo"), F.col("s.__top").alias("__hi"), F.col("s.__sum").alias("__before"), F.col("s.__n").alias("__n"))
        state = materialize(state.where(F.col("__n") <= SLICE_ROWS).unionByName(found))


def _fill(rows: DataFrame) -> DataFrame:
    """__source, __id, __tie, __extra: how many of the __m rows of each document of the slices are taken, in order of the keys:
    as many as fit into what is left; then one of the first that brings its source nearer to the target than leaving it."""
    each = rows.groupBy("__source").agg(F.array_sort(F.collect_list(F.struct("__key", "__id", "__tie", "__size", "__m"))).alias("a"), F.first(F.col("__rest") - F.col("__before")).alias("left"))
    start = F.struct(F.col("left").cast("double").alias("left"), F.array().cast("array<bigint>").alias("n"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x["__size"] > 0, F.least(x["__m"], F.floor(F.greatest(F.lit(0.0), s["left"]) / x["__size"]).cast("long"))).otherwise(F.lit(0).cast("long"))
        return F.struct((s["left"] - n * x["__size"]).alias("left"), F.concat(s["n"], F.array(n)).alias("n"))

    folded = each.withColumn("f", F.aggregate("a", start, step))
    both = F.arrays_zip(F.col("a"), F.col("f.n").alias("n"))
    nearer = F.transform(both, lambda x: (x["n"] < x["a"]["__m"]) & (x["a"]["__size"] > 0) & (x["a"]["__size"] < 2 * F.col("f.left")))
    found = folded.withColumn("more", F.array_position(nearer, F.lit(True))).select("__source", "more", F.posexplode(both).alias("at", "x"))
    return found.select(F.col("__source").alias("__of"), F.col("x.a.__id").alias("__oid"), F.col("x.a.__tie").alias("__otie"), F.col("x.a.__size").alias("__osize"), (F.col("x.n") + (F.col("more") == F.col("at") + 1).cast("long")).alias("__extra"))


def mix_groups(rows: DataFrame, size: str = "size", source: str = "source", quality: str = "quality", row_id: str = "doc_id", tie: str = "text_hash") -> DataFrame:
    """__source, __id, __tie, __size, __quality, __m (rows that are equal in these), source_size, target, __epochs (how often
    the mix takes each) and __extra (how many of them it takes once more)."""
    named = {source: "__source", row_id: "__id", tie: "__tie", size: "__size", quality: "__quality"}
    alike = materialize(rows.groupBy(*[F.col(c).alias(n) for c, n in named.items()]).agg(F.count("*").alias("__m")).withColumn("__words", F.col("__size") * F.col("__m")))
    sizes = alike.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size"), F.sum("__m").alias("rows"))
    plan = broadcast_under(materialize(targets(sizes)), BROADCAST_SOURCES).select(F.col("source").alias("__of"), "source_size", "target")
    u = F.xxhash64(F.coalesce(F.col("__id"), F.lit(-1)), F.col("__tie"), F.lit("mix")).cast("double") / F.lit(2.0**64) + 0.5
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    keyed = alike.join(plan, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of").withColumn("__epochs", epochs)
    keyed = keyed.withColumns({"__key": -F.log(F.greatest(u, F.lit(1e-300))) / F.col("__quality"), "__rest": F.col("target") - F.col("__epochs") * F.col("source_size")})
    bounds = broadcast_under(materialize(_slice_of(keyed)), BROADCAST_SOURCES).withColumnRenamed("__source", "__of")
    met = keyed.join(bounds, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")
    inside = (F.col("__key") > F.col("__lo")) & (F.col("__key") <= F.col("__hi"))
    filled = _fill(met.where(inside))
    same = F.col("__source").eqNullSafe(F.col("__of")) & F.col("__id").eqNullSafe(F.col("__oid")) & F.col("__tie").eqNullSafe(F.col("__otie")) & (F.col("__size") == F.col("__osize"))
    part = met.where(inside).join(broadcast_under(materialize(filled), 100_000), same).drop("__of", "__oid", "__otie", "__osize")
    whole = met.where(~F.coalesce(inside, F.lit(False))).withColumn("__extra", F.when(F.col("__key") <= F.col("__lo"), F.col("__m")).otherwise(0).cast("long"))
    return whole.unionByName(part).drop("__key", "__rest", "__lo", "__hi", "__before", "__words")


def mix(rows: DataFrame, size: str = "size", source: str = "source", quality: str = "quality", row_id: str = "doc_id", tie: str = "text_hash") -> DataFrame:
    """size, source, quality, row_id, tie of every row, and source_size, target, copies (how often the mix takes the row)."""
    groups = mix_groups(rows, size, source, quality, row_id, tie)
    each = groups.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    copies = (F.col("__epochs") + (F.col("__n") <= F.col("__extra")).cast("long")).alias("copies")
    return each.select(F.col("__id").alias(row_id), F.col("__source").alias(source), F.col("__size").alias(size), F.col("__quality").alias(quality), F.col("__tie").alias(tie), "source_size", "target", copies)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality"), F.xxhash64("text").alias("text_hash"))


def mix_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, quality of every document, and source or text_hash if named in keep."""
    return mix(_measured(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "quality", *keep)


def apply_mix(docs: DataFrame) -> DataFrame:
    """Each row of docs as often as the mixture takes it; all columns stay. Of rows that are equal in source, id and text the
    ones taken once more are drawn by a hash of their places, as many on average as the mixture takes."""
    groups = mix_groups(_measured(docs)).where("__epochs > 0 or __extra > 0")
    copies = groups.select("__source", "__id", "__tie", "__m", "__epochs", "__extra")
    same = F.col("source").eqNullSafe(F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tie"))
    taken = with_row_key(docs, "__row").join(copies, same)
    more = (F.col("__extra") == F.col("__m")) | (F.pmod(F.xxhash64("__row"), F.col("__m")) < F.col("__extra"))
    taken = taken.withColumn("__n", F.col("__epochs") + more.cast("long")).where("__n > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*[taken[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
