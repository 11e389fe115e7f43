"""On-screen text: hits of scans, merging of appearances, consensus of readings, and texts that recur.

Merging, consensus and grouping compare texts by matching blocks in a given order, which has no form in SQL: they run as
pandas groups: one island of hits in time, one appearance's readings, or one recording's matches.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import normalized_ocr, reading_key, reading_similarity
from spanlake.operators.candidates import islands

#: Slack in seconds; least similarities of texts and descriptions; weights of a reading's source.
SLACK, SAME_TEXT, SAME_DESCRIPTION, ONLY_DESCRIPTION, SAME_ENTITY = 1.25, 0.78, 0.35, 0.65, 0.90
SOURCE_WEIGHTS = {"crop": 1.0, "frame": 0.85, "coarse": 0.5}
#: What a more confident observation of the same appearance replaces.
REPLACED = ["best_timestamp", "coarse_ocr_text", "ocr_text", "readable", "confidence", "target_description", "visual_evidence"]


def scan_hits(rows: DataFrame, floor: float = 0.20) -> DataFrame:
    """Scan results (window_start, window_end, start_seconds, end_seconds, confidence, ...) as intervals of the recording:
    held to the window, reversed bounds swapped, empty ones a quarter of a second long."""
    held = lambda c: F.least(F.col("window_end"), F.greatest(F.col("window_start"), F.col("window_start") + F.col(c)))
    s, e = F.least(held("start_seconds"), held("end_seconds")), F.greatest(held("start_seconds"), held("end_seconds"))
    out = rows.where(F.col("confidence") >= floor).withColumns({"start": s, "end": e})
    return out.withColumn("end", F.when(F.col("end") <= F.col("start"), F.least("window_end", F.col("start") + 0.25)).otherwise(F.col("end")))


def clamp_box(box: Column) -> Column:
    """A box in thousandths, held to 0..1000, reversed sides swapped."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), box[c]))
    lo = lambda a, b: F.least(held(a), held(b))
    hi = lambda a, b: F.greatest(held(a), held(b))
    return F.struct(lo("x1", "x2").alias("x1"), lo("y1", "y2").alias("y1"), hi("x1", "x2").alias("x2"), hi("y1", "y2").alias("y2"))


def crop_box(box: Column, width: Column, height: Column, pad: float = 0.10) -> Column:
    """Pixels of a box with padding on all sides, rounded outwards and held to the frame."""
    b = clamp_box(box)
    dx, dy = (b["x2"] - b["x1"]) * pad, (b["y2"] - b["y1"]) * pad
    low = lambda x, size: F.greatest(F.lit(0), F.floor(x / 1000 * size)).cast("int")
    high = lambda x, size: F.least(size, F.ceil(x / 1000 * size)).cast("int")
    return F.struct(low(b["x1"] - dx, width).alias("left"), low(b["y1"] - dy, height).alias("top"), high(b["x2"] + dx, width).alias("right"), high(b["y2"] + dy, height).alias("bottom"))


def rank_crops(readings: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The best readings of each appearance by confidence, sharpness and area."""
    from pyspark.sql import Window

    area = (F.col("bbox.x2") - F.col("bbox.x1")) * (F.col("bbox.y2") - F.col("bbox.y1"))
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc(F.log1p(F.greatest(F.lit(0.0), F.col("sharpness")))), F.desc(area), "timestamp")
    return readings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def best_frame(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The reading to show for each appearance: by confidence, then sharpness, then time."""
    order = F.struct(F.coalesce("confidence", F.lit(0.0)), F.log1p(F.greatest(F.lit(0.0), F.coalesce("sharpness", F.lit(0.0)))), -F.col("timestamp"))
    return readings.groupBy(*keys).agg(F.max_by("timestamp", order).alias("best_timestamp"), F.max("confidence").alias("best_confidence"))


def _alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0


class Appearance:
    """Scan hits that show one text: how far they reach, and the hit that speaks for them, the most confident one."""

    def __init__(self, hit: dict):
        self.hits, self.reach, self.voice = [hit], hit["end"], hit

    def add(self, hit: dict) -> None:
        self.hits.append(hit)
        self.reach, self.voice = max(self.reach, hit["end"]), max(self.voice, hit, key=lambda h: h["confidence"] or 0)

    def shows(self, hit: dict) -> bool:
        """The texts agree and the descriptions don't contradict; without two texts the descriptions must agree."""
        a, b = hit["target_description"] or "", self.voice["target_description"] or ""
        if hit["ocr_text"] and self.voice["ocr_text"]:
            return (not a or not b or _alike(a, b) >= SAME_DESCRIPTION) and reading_similarity(hit["ocr_text"], self.voice["ocr_text"]) >= SAME_TEXT
        return _alike(a, b) >= ONLY_DESCRIPTION

    def row(self) -> dict:
        own = {"start": min(h["start"] for h in self.hits), "end": self.reach, "observations": len(self.hits)}
        return self.hits[0] | {k: self.voice[k] for k in REPLACED if k in self.voice} | own


def merged_rows(rows: list[dict]) -> list[dict]:
    """Appearances in order of time; a hit joins the latest one that it continues, as far back as they reach it."""
    found: list[Appearance] = []
    for hit in sorted(rows, key=lambda r: (r["start"], r["end"])):
        near = takewhile(lambda a, s=hit["start"]: s <= a.reach + SLACK, reversed(found))
        home = next((a for a in near if a.shows(hit)), None)
        home.add(hit) if home else found.append(Appearance(hit))
    return sorted((a.row() for a in found), key=lambda r: r["start"])


def merge_appearances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scan hits of each recording with repeats from overlapping windows as one; observations counts them.

    Hits that no others reach can't join them, so a recording is cut there first, and a task sees one such island."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", observations long"
    names = [*rows.columns, "observations"]
    cut = islands(rows, keys, SLACK)
    return cut.groupBy(*keys, "island").applyInPandas(lambda g: pd.DataFrame(merged_rows(g.drop(columns="island").astype(object).where(g.notna(), None).to_dict("records")), columns=names), schema)


def leaders(texts: list[str], limit: float, confidences: list[float] | None = None) -> list[int]:
    """For each text the place of the first earlier one whose group it joins, or its own. A group is known by its first text,
    or, with confidences, by its most confident one so far."""
    voice: dict[int, int] = {}
    out = []
    for i, text in enumerate(texts):
        home = next((k for k, at in voice.items() if reading_similarity(text, texts[at]) >= limit), i)
        if home == i or confidences and confidences[i] > confidences[voice[home]]:
            voice[home] = i
        out.append(home)
    return out


def consensus(readings: list[tuple[str | None, float]]) -> tuple[str, float]:
    """(text, confidence) on which the readings agree most: they gather about the most confident ones, the heaviest gathering
    gives its most confident (then longest) text and the mean of its three best confidences."""
    known = sorted(((t, float(c)) for t, c in ((normalized_ocr(t), c) for t, c in readings) if t), key=lambda r: -r[1])
    if not known:
        return "", 0.0
    weight: dict[int, float] = {}
    home = leaders([t for t, _ in known], SAME_TEXT)
    for k, (_, c) in zip(home, known, strict=True):
        weight[k] = weight.get(k, 0.0) + max(0.05, c)
    best = max(weight, key=weight.__getitem__)
    own = [r for k, r in zip(home, known, strict=True) if k == best]  # most confident first
    top = [c for _, c in own[:3]]
    return max(own, key=lambda r: (r[1], len(reading_key(r[0]))))[0], sum(top) / len(top)


def grouped_texts(rows: list[tuple[str | None, float]]) -> list[tuple[str, float, list[int]]]:
    """(text, confidence, places) of texts that are nearly the same, each group by its most confident text, in their order."""
    known = [(i, t, c) for i, (t, c) in enumerate((normalized_ocr(t), c) for t, c in rows) if t]
    home = leaders([t for _, t, _ in known], SAME_ENTITY, [c for *_, c in known])
    groups = [[r for k, r in zip(home, known, strict=True) if k == lead] for lead in dict.fromkeys(home)]
    out = [(max(g, key=lambda r: r[2])[1], max(r[2] for r in g), [r[0] for r in g]) for g in groups]
    return sorted(out, key=lambda g: g[0].casefold())


def consensus_text(readings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ocr_text, ocr_confidence from readings (ocr_text, confidence, source); a source weighs its confidences."""
    weights = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])
    weighed = readings.select(*keys, "ocr_text", (F.col("confidence") * F.coalesce(weights[F.col("source")], F.lit(1.0))).alias("confidence"))
    schema = ", ".join(f"`{k}` {weighed.schema[k].dataType.simpleString()}" for k in keys) + ", ocr_text string, ocr_confidence double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["confidence", "ocr_text"], ascending=[False, True], kind="stable")
        text, confidence = consensus(list(zip(ordered["ocr_text"], ordered["confidence"], strict=True)))
        return pd.DataFrame([[*group[keys].iloc[0], text, confidence]], columns=[*keys, "ocr_text", "ocr_confidence"])

    return weighed.groupBy(*keys).applyInPandas(run, schema)


def text_entities(matches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, text, confidence, appearances (their order values) from matches (ocr_text, ocr_confidence) in the given order."""
    kind = matches.schema[order].dataType.simpleString()
    schema = ", ".join(f"`{k}` {matches.schema[k].dataType.simpleString()}" for k in keys) + f", text string, confidence double, n_appearances long, appearances array<{kind}>"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order, kind="stable")
        found = grouped_texts(list(zip(g["ocr_text"], g["ocr_confidence"].fillna(0.0), strict=True)))
        places = g[order].tolist()
        return pd.DataFrame([[*group[keys].iloc[0], t, c, len(p), [places[i] for i in p]] for t, c, p in found], columns=[*keys, "text", "confidence", "n_appearances", "appearances"])

    return matches.select(*keys, order, "ocr_text", "ocr_confidence").groupBy(*keys).applyInPandas(run, schema)
