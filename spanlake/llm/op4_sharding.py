"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, rows are range-partitioned by them,
and overfull ranges are subdivided until none is left.

The sort key is (hash of the text, document id, hash of the row's place in its files), so equal texts stand side by side and
a group of any size, even of rows that are equal in all columns, can be split anywhere. The splitters cut the keys into many
more ranges than there are shards. A shard's own boundary is the splitter at its quantile made exact: totals of all ranges
say in which range the quantile lies, and only the keys of those few ranges are sorted to find the row. A boundary inside a
group of equal texts moves to the group's start if the whole group is no larger than the largest row, so that small groups
stay together and sizes stay equal to within two rows.

All of that works on keys and sizes. Whole rows move once, to the task of their range, where they are numbered; the number
of ranges grows with the data, so no task holds more than about `RANGE_BYTES`. The driver holds sampled keys and one pair of
totals a range.

Defined results: a null text has size 1 and the crc32 of no bytes; null ids sort first among equal texts; repeated rows
each get a slot of their own; an empty table gives an empty result; other columns pass through `shard_texts` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, packed, place_of, quantile_keys, sampled_keys, table, with_row_key

LAW = "bytes"
NULL_ID = -(2**63)
KEY = ["__h", "__i", "__t"]
#: Bytes that a range should hold, ranges a shard at least, samples a range, and how many times too large is overfull.
RANGE_BYTES, RANGES, SAMPLES, OVERFULL = 128 << 20, 32, 32, 4.0


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


@dataclass
class Plan:
    """splitters of the ranges, rows before each range, boundaries of the shards (packed keys), first place of each shard."""

    splitters: object
    before: object
    boundaries: object
    starts: list[int]


def _split(keys: DataFrame, total: int, shards: int):
    """Splitters by quantiles of a size-weighted sample, more of them wherever a range is still overfull."""
    import numpy as np

    spark = keys.sparkSession
    ranges = max(shards * RANGES, -(-total // RANGE_BYTES))
    rate, salt, grown = ranges * SAMPLES / total, 1, True
    splitters = quantile_keys(*sampled_keys(keys, KEY, "__s", rate, salt), ranges)
    while True:
        r = place_of(spark, splitters)(*KEY)
        per = keys.groupBy(r.alias("r")).agg(F.sum("__s").alias("s"), F.count("*").alias("n")).collect()
        full = [x["r"] for x in per if x["s"] > OVERFULL * total / ranges and x["n"] > 1]
        held = sum(x["s"] for x in per if x["r"] in set(full))
        if not full or rate >= 1 and salt > 1 and not grown:
            # with every row drawn and nothing gained, what is left are single keys
            return splitters, {x["r"]: (x["s"], x["n"]) for x in per}
        salt, rate = salt + 1, min(1.0, max(4 * rate, len(full) * 8 * SAMPLES / held))
        inside = spark.createDataFrame([(int(x),) for x in full], "r long")
        more = keys.withColumn("r", r).join(F.broadcast(inside), "r", "left_semi")
        drawn, weights = sampled_keys(more, KEY, "__s", rate, salt)
        at = np.searchsorted(splitters, drawn)
        parts = [(drawn[at == x], weights[at == x]) for x in full]
        found = [quantile_keys(k, w, 1 + int(2 * w.sum() * ranges / total)) for k, w in parts]
        # the key before each cut is one as well, which sets a large row apart from those before it
        found += [k[np.maximum(np.searchsorted(k, cuts) - 1, 0)] for (k, _), cuts in zip(parts, found, strict=True) if len(k)]
        was, splitters = len(splitters), np.unique(np.concatenate([splitters, *found]))
        grown = len(splitters) > was


def plan_shards(keys: DataFrame, shards: int) -> Plan | None:
    """The plan for a materialized table of keys (__h, __i, __t) and sizes __s above 0; None for an empty one."""
    import numpy as np

    spark = keys.sparkSession
    total, count, largest = keys.agg(F.sum("__s"), F.count("*"), F.max("__s")).first()
    if not count:
        return None
    splitters, per = _split(keys, total, shards)
    sizes, rows = (np.array([per.get(r, (0, 0))[j] for r in range(len(splitters) + 1)], np.int64) for j in (0, 1))
    size_before, before = (np.concatenate([[0], np.cumsum(x)[:-1]]) for x in (sizes, rows))
    # the range that holds a shard's quantile, and the next one with rows in it, hold the shard's first row
    where = np.searchsorted(size_before, [total * k / shards for k in range(1, shards)], side="right") - 1
    full = np.flatnonzero(rows)
    wanted = {int(full[min(i, len(full) - 1)]) for r in where for i in (np.searchsorted(full, r), np.searchsorted(full, r) + 1)}
    offsets = spark.createDataFrame([(r, int(size_before[r]), int(before[r])) for r in sorted(wanted)], "__r long, __p long, __n long")
    near = keys.withColumn("__r", place_of(spark, splitters)(*KEY)).join(F.broadcast(offsets), "__r")
    w = Window.partitionBy("__r").orderBy(*KEY)
    upto = F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = (F.col("__p") + upto).cast("decimal(38,0)") * 2 - F.col("__s")
    placed = near.withColumns({"shard": F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * total)).cast("int")), "at": F.col("__n") + F.row_number().over(w) - 1})
    firsts = {r["shard"]: r for r in placed.groupBy("shard").agg(F.min(F.struct("at", *KEY)).alias("first")).collect()}
    cuts = [firsts[k]["first"] if k in firsts else None for k in range(1, shards)]
    known = [c for c in cuts if c is not None]
    if known:
        below = lambda c: (F.col("__i") < c["__i"]) | ((F.col("__i") == c["__i"]) & (F.col("__t") < c["__t"]))
        sums = [x for n, c in enumerate(known) for x in (F.sum(F.when(F.col("__h") == c["__h"], F.col("__s"))).alias(f"s{n}"), F.count(F.when((F.col("__h") == c["__h"]) & below(c), 1)).alias(f"n{n}"))]
        groups = keys.where(F.col("__h").isin([c["__h"] for c in known])).agg(*sums).first()
        moved = {id(c): (c["__h"], NULL_ID, NULL_ID, c["at"] - groups[f"n{n}"]) if groups[f"s{n}"] <= largest else (c["__h"], c["__i"], c["__t"], c["at"]) for n, c in enumerate(known)}
    bounds, starts = [], [0]
    for c in reversed(cuts):  # a shard without a row begins where the next one does
        bounds.append(moved[id(c)] if c is not None else bounds[-1] if bounds else (2**63 - 1, 2**63 - 1, 2**63 - 1, count))
    bounds.reverse()
    starts += [b[3] for b in bounds]
    return Plan(splitters, before, packed(*np.array([b[:3] for b in bounds], np.int64).T) if bounds else splitters[:0], starts)


def apply_plan(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (with the key columns) with shard and slot: each moves once, to its range, and is counted there."""
    spark = rows.sparkSession
    offsets = spark.createDataFrame([(r, int(n)) for r, n in enumerate(plan.before)], "__r long, __n long")
    starts = F.expr(f"element_at(array({', '.join(f'{n}L' for n in plan.starts)}), __shard + 1)")
    ranged = rows.withColumns({"__r": place_of(spark, plan.splitters)(*KEY), "__shard": place_of(spark, plan.boundaries, "right")(*KEY).cast("int")}).join(F.broadcast(offsets), "__r")
    slot = F.col("__n") + F.row_number().over(Window.partitionBy("__r").orderBy(*KEY)) - 1 - starts
    return ranged.withColumns({"slot": slot.cast("long"), "shard": F.col("__shard")}).drop(*KEY, "__r", "__n", "__shard")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return with_row_key(docs, "__t").withColumns({"__h": F.xxhash64(text), "__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))})


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; texts never leave the scan."""
    keyed = _keyed(docs).select("doc_id", text_size(F.col("text")).alias("__s"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), *KEY)
    keys = materialize(keyed)
    plan = plan_shards(keys.select("__s", *KEY), shards)
    placed = apply_plan(keys, plan) if plan else keys.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    return placed.select("doc_id", F.col("__s").alias("size"), "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_texts(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The rows themselves with size, text_crc32, law, shard, slot and grown_shard, which replace columns of these names.

    The plan is made from keys and sizes, a small table; whole rows are shuffled once, by the result itself."""
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keyed = _keyed(docs.drop(*own))
    keys = materialize(keyed.select(text_size(F.col("text")).alias("__s"), *KEY))
    plan = plan_shards(keys, shards)
    rows = keyed.withColumns({"size": text_size(F.col("text")), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    placed = apply_plan(rows, plan) if plan else rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop(*KEY)
    others = [c for c in placed.columns if c not in own]
    return placed.select(*others, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
