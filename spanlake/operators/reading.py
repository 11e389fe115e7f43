"""On-screen text, the whole way: scan, appearances, frames, crops, consensus, matches and the texts that recur."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake import schema
from spanlake.functions.text import normalize_ocr
from spanlake.operators import ocr
from spanlake.operators.evidence import KEYS
from spanlake.operators.verify import ModelBackend, json_answers
from spanlake.operators.windows import refine_times, scan_windows
from spanlake.plans.specs import TARGET_DEFAULTS
from spanlake.sources.scratch import materialize
from spanlake.sources.tables import number_matches

#: Images that a model gets at once.
IMAGES = 6


def _answered(said: DataFrame, keys: list[str], stage: str, failed: list[DataFrame] | None) -> DataFrame:
    """Rows with an answer; the others go to failed (keys, stage, error), where the caller can see what is missing."""
    if failed is not None:
        failed.append(said.where("error is not null").select(*keys, F.lit(stage).alias("stage"), "error"))
    return said.where("error is null")


def scan_texts(videos: DataFrame, backend: ModelBackend, keys: list[str] = KEYS, window: float = 30.0, overlap: float = 2.0, floor: float = 0.20, failed: list[DataFrame] | None = None) -> DataFrame:
    """Appearances of the wanted text in each recording, from a coarse scan in overlapping windows.

    videos: keys, duration, and what the model is to be told (query and target fields), one row a query and recording."""
    shown = scan_windows(videos, window, overlap).withColumnsRenamed({"start": "window_start", "end": "window_end"}).drop("idx")
    said = _answered(json_answers(shown, backend.scan, schema.OCR_SCAN, "scan"), keys, "scan", failed)
    item = said.select(*videos.columns, "window_start", "window_end", F.explode("scan.items").alias("i")).select(*videos.columns, "window_start", "window_end", "i.*")
    text = normalize_ocr(F.col("ocr_text"))
    best = F.least(F.col("window_end"), F.greatest(F.col("window_start"), F.col("window_start") + F.col("best_frame_seconds")))
    hits = ocr.scan_hits(item, floor).withColumns({"ocr_text": text, "coarse_ocr_text": text, "best_timestamp": best})
    kept = hits.select(*keys, "start", "end", "best_timestamp", "coarse_ocr_text", "ocr_text", "readable", "confidence", "target_description", "visual_evidence")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "best_timestamp", "ocr_text", "target_description")) - 1
    found = ocr.merge_appearances(kept, keys).withColumn("appearance", place)
    return materialize(found.join(videos, keys))


def read_frames(appearances: DataFrame, backend: ModelBackend, keys: list[str] = KEYS, fps: float = 6.0, padding: float = 1.25, most: int = 14, failed: list[DataFrame] | None = None) -> DataFrame:
    """Readings (timestamp, ocr_text, confidence, readable, bbox, sharpness) of each appearance in the frames about it that show
    its target, asked for in batches of IMAGES frames in order of time."""
    by = [*keys, "appearance"]
    told = [c for c in appearances.columns if c not in by]
    times = refine_times(appearances.withColumn("best", F.col("best_timestamp")), fps, padding, most)
    order = F.row_number().over(Window.partitionBy(*by).orderBy("time")) - 1
    batches = times.withColumn("batch", F.floor(order / IMAGES)).groupBy(*by, "batch").agg(F.array_sort(F.collect_list("time")).alias("times"), *[F.first(c).alias(c) for c in told])
    said = _answered(json_answers(batches, backend.read_frames, schema.OCR_FRAME, "answer"), keys, "frames", failed)
    each = said.select(*by, "times", F.explode("answer.readings").alias("r")).where(F.col("r.target_present") & F.col("r.image_index").between(0, F.size("times") - 1))
    box = ocr.clamp_box(F.col("r.bbox"))
    rows = each.select(*by, F.get("times", F.col("r.image_index")).alias("timestamp"), normalize_ocr(F.col("r.ocr_text")).alias("ocr_text"), "r.readable", "r.confidence", "r.target_description", box.alias("bbox"))
    seen = rows.where("bbox.x2 > bbox.x1 and bbox.y2 > bbox.y1")

    def measured(parts):
        for b in parts:
            yield b.assign(sharpness=[float(x) for x in backend.sharpness(b)] if len(b) else [])

    flat = seen.withColumns({f"__{c}": F.col(f"bbox.{c}") for c in ("x1", "y1", "x2", "y2")}).drop("bbox")
    schema_out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields) + ", sharpness double"
    sharp = flat.mapInPandas(measured, schema_out)
    return materialize(sharp.withColumn("bbox", F.struct(*[F.col(f"__{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])).drop("__x1", "__y1", "__x2", "__y2"))


def read_crops(readings: DataFrame, appearances: DataFrame, backend: ModelBackend, keys: list[str] = KEYS, most: int = 5, failed: list[DataFrame] | None = None) -> DataFrame:
    """Readings of the best crops of each appearance: ocr_text, readable, confidence, timestamp."""
    by = [*keys, "appearance"]
    best = ocr.rank_crops(readings, by, most)
    crops = best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "timestamp", "bbox"))), lambda x: F.struct(x["timestamp"].alias("timestamp"), x["bbox"].alias("bbox"))).alias("crops"))
    asked = crops.join(appearances, by)
    said = _answered(json_answers(asked, backend.read_crops, schema.OCR_CROP, "answer"), keys, "crops", failed)
    each = said.select(*by, "crops", F.explode("answer.readings").alias("r")).where(F.col("r.image_index").between(0, F.size("crops") - 1))
    return each.select(*by, normalize_ocr(F.col("r.ocr_text")).alias("ocr_text"), "r.readable", "r.confidence", F.get("crops", F.col("r.image_index"))["timestamp"].alias("timestamp"))


def read_texts(videos: DataFrame, backend: ModelBackend, keys: list[str] = KEYS, return_mode: str = "all") -> dict[str, DataFrame]:
    """appearances, matches and entities of the text that each query asks for in each recording, and `failed`: where the model
    gave no fitting answer (keys, stage, error).

    videos: keys, duration, query and, if a plan gave them, the target fields; missing ones take their defaults. With
    return_mode best only the appearance with the surest reading of each query and recording is kept."""
    told = videos.withColumns({name: F.coalesce(F.col(name), F.lit(text)) if name in videos.columns else F.lit(text) for name, text in TARGET_DEFAULTS.items()})
    failed: list[DataFrame] = []
    found = scan_texts(told, backend, keys, failed=failed)
    by = [*keys, "appearance"]
    frames = read_frames(found, backend, keys, failed=failed)
    crops = read_crops(frames, found, backend, keys, failed=failed)
    source = lambda rows, name, text="ocr_text": rows.select(*by, F.col(text).alias("ocr_text"), "confidence", F.lit(name).alias("source"))
    agreed = ocr.consensus_text(source(crops, "crop").unionByName(source(frames, "frame")).unionByName(source(found, "coarse", "coarse_ocr_text")), by)
    shown = ocr.best_frame(frames, by).select(*by, F.col("best_timestamp").alias("__best"))
    rows = found.drop("ocr_text", "readable").join(agreed, by).join(shown, by, "left")
    unread = F.concat(F.lit("Visible "), F.col("target_region"), F.lit("; requested text unreadable"))
    rows = rows.withColumns({
        "best_timestamp": F.coalesce("__best", "best_timestamp"), "confidence": F.greatest("confidence", "ocr_confidence"), "readable": F.col("ocr_text") != "",
        "description": F.when(F.col("ocr_text") != "", F.concat("text_description", F.lit(": "), "ocr_text")).otherwise(unread),
    }).drop("__best")
    rows = materialize(rows)
    kept = rows
    if return_mode == "best":
        w = Window.partitionBy(*keys).orderBy(F.desc("ocr_confidence"), F.desc("confidence"), "appearance")
        kept = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    matches = number_matches(kept, keys, "appearance")
    return {"appearances": rows, "matches": matches, "entities": ocr.text_entities(matches, keys, "match_id"), "failed": reduce(DataFrame.unionByName, failed)}
