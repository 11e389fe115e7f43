"""Greedy passes over small ordered groups, folded in the JVM: suppression of overlapping detections.

A group is one query's detections or candidates in one video, which limits before these stages keep small (tens of rows);
groups are many, and that is the parallelism.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.intervals import iou
from spanlake.functions.text import GENERIC_ACTORS, actor_signature, jaccard
from spanlake.operators.evidence import KEYS


def greedy_keep(rows: DataFrame, keys: list[str], order: list[Column], duplicate: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of each group in order, without those that are a duplicate of one kept before: duplicate(kept, row)."""
    fields = [c for c in rows.columns if c not in keys]
    item = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__order"), *fields)
    sorted_ = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__all"))
    keep = F.aggregate("__all", F.slice("__all", 1, 0), lambda kept, d: F.when(F.exists(kept, lambda k: duplicate(k, d)), kept).otherwise(F.concat(kept, F.array(d))))
    return sorted_.select(*keys, F.explode(keep).alias("__d")).select(*keys, *[F.col(f"__d.{f}").alias(f) for f in fields])


def _near(k: Column, d: Column, limit: float) -> Column:
    return iou(k["start"], k["end"], d["start"], d["end"]) >= limit


def _actors(k: Column, d: Column) -> Column:
    """Similarity of two rows' actors; signatures are not empty unless the text is blank."""
    blank = (F.size(k["__actor"]) == 0) | (F.size(d["__actor"]) == 0)
    return F.when(blank, 1.0).otherwise(jaccard(k["__actor"], d["__actor"]))


def _actor_ratio(a: str | None, b: str | None) -> float:
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if not a or not b:
        return 1.0
    x, y = ({t for t in re.findall("[a-z0-9]+", s) if t not in GENERIC_ACTORS} for s in (a, b))
    return len(x & y) / len(x | y) if x and y else SequenceMatcher(None, a, b).ratio()


def _greedy_rows(group: pd.DataFrame, duplicate: Callable) -> pd.DataFrame:
    kept: list = []
    for row in group.sort_values(["confidence", "start", "end"], ascending=[False, True, True], kind="stable").itertuples():
        if not any(duplicate(k, row) for k in kept):
            kept.append(row)
    return group.loc[[k.Index for k in kept]]


def _overlap(a, b) -> float:
    hull = max(a.end, b.end) - min(a.start, b.start)
    return max(0.0, min(a.end, b.end) - max(a.start, b.start)) / hull if hull > 0 else 0.0


def _suppress(rows: DataFrame, keys: list[str], in_jvm: Callable[[Column, Column], Column], in_python: Callable) -> DataFrame:
    """Groups whose actors' words tell them apart are folded in the JVM; those with a description of generic words only,
    which are compared letter by letter, as pandas groups."""
    signed = rows.withColumn("__actor", actor_signature(F.col("actor_description")))
    vague = (F.size("__actor") == 0) & (F.length(F.trim(F.coalesce("actor_description", F.lit("")))) > 0)
    odd = signed.where(vague).select(*keys).distinct()
    plain = greedy_keep(signed.join(odd, keys, "left_anti"), keys, [-F.col("confidence"), F.col("start"), F.col("end")], in_jvm).drop("__actor")
    schema = rows.schema
    rest = rows.join(odd, keys, "left_semi").select(*rows.columns).groupBy(*keys).applyInPandas(lambda g: _greedy_rows(g, in_python), schema)
    return plain.select(*rows.columns).unionByName(rest)


def temporal_nms(detections: DataFrame, keys: list[str] = KEYS, limit: float = 0.55, distinct_actors: float = 0.40) -> DataFrame:
    """Without detections that overlap a more confident one, unless both name actors and these differ."""
    differ = lambda k, d: (F.length(F.trim(F.coalesce(k["actor_description"], F.lit("")))) > 0) & (F.length(F.trim(F.coalesce(d["actor_description"], F.lit("")))) > 0) & (_actors(k, d) < distinct_actors)
    return _suppress(
        detections, keys, lambda k, d: _near(k, d, limit) & ~differ(k, d),
        lambda k, d: _overlap(k, d) >= limit and not (k.actor_description and d.actor_description and _actor_ratio(k.actor_description, d.actor_description) < distinct_actors),
    )


def deduplicate(detections: DataFrame, keys: list[str] = KEYS, limit: float = 0.65, same_actor: float = 0.45) -> DataFrame:
    """Without detections that overlap a more confident one of a similar or unnamed actor."""
    return _suppress(
        detections, keys, lambda k, d: _near(k, d, limit) & (_actors(k, d) >= same_actor),
        lambda k, d: _overlap(k, d) >= limit and _actor_ratio(k.actor_description, d.actor_description) >= same_actor,
    )
