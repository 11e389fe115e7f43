"""Schemas of the engine's tables and of the structured outputs of models, and checks of such outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIDEOS = "video_id string, path string, duration double, width int, height int, video_codec string, audio_codec string, created_at double, status string"
CHUNKS = "video_id string, scale string, idx long, chunk_id string, start double, end double, duration double, relative_path string"
CHUNK_LINKS = "video_id string, parent_id string, child_id string, overlap double"
WORDS = "video_id string, start double, end double, word string"
SEGMENTS = "video_id string, start double, end double, text string"
HITS = "video_id string, query_id string, channel string, ranking long, rank int, chunk_id string, start double, end double, score double, predicate_id string, role string, required boolean, importance double"
EVIDENCE = "video_id string, query_id string, bin_id long, start double, end double, center double, score double"
DETECTIONS = "video_id string, query_id string, start double, end double, confidence double, description string, actor_description string, visual_evidence string"

_LISTS = ", ".join(f"{x} array<string>" for x in ("people", "objects", "actions", "interactions", "motion_events", "state_changes", "visible_text", "search_terms"))
SCENE = f"summary string, scene string, {_LISTS}, important_events array<struct<start_seconds double, end_seconds double, description string>>"
PREDICATE = "struct<id string, description string, role string, modalities array<string>, required boolean, importance double>"
PLAN = (
    "query_type string, executor string, routing_reason string, return_mode string, target_object string, target_region string, text_description string, "
    "extraction_instruction string, visual_queries array<string>, metadata_queries array<string>, transcript_queries array<string>, target_event string, "
    f"evidence_predicates array<{PREDICATE}>, negative_evidence array<string>, temporal_constraints array<string>, "
    "ordering array<struct<first string, then string, description string>>, subevents array<struct<description string, order int>>, "
    "expected_duration struct<min_seconds double, max_seconds double>, requires_temporal_order boolean, "
    "event_definition struct<counts_as_match array<string>, does_not_count array<string>>, "
    "weights struct<video double, metadata double, transcript_semantic double, transcript_bm25 double>"
)
VERIFY = "present boolean, instances array<struct<start_seconds double, end_seconds double, confidence double, description string, actor_description string, visual_evidence string>>"
CONFIRM = "valid boolean, confidence double, start_seconds double, end_seconds double, description string, actor_description string, reason string"
BOUNDARY = "event_present boolean, contains_boundary boolean, confidence double, boundary_seconds double, state_before string, state_after string"
OCR_SCAN = "items array<struct<start_seconds double, end_seconds double, best_frame_seconds double, confidence double, ocr_text string, target_description string, visual_evidence string, readable boolean>>"
OCR_FRAME = "readings array<struct<image_index int, target_present boolean, ocr_text string, readable boolean, confidence double, target_description string, bbox struct<x1 double, y1 double, x2 double, y2 double>>>"
OCR_CROP = "readings array<struct<image_index int, ocr_text string, readable boolean, confidence double>>"
SPEECH = "words array<struct<start double, end double, word string>>, segments array<struct<start double, end double, text string>>"
#: What enumerated fields may hold.
ENUMS = {"executor": ("temporal_grounding", "visual_text_extraction"), "return_mode": ("all", "best")}


def valid_json(text: Column, schema: str, enums: dict[str, tuple] | None = None) -> Column:
    """Whether text is an object with exactly the schema's fields, each of its type and none null, enums respected."""
    names = [f.name for f in _fields(schema)]
    parsed = F.from_json(text, schema)
    keys = F.json_object_keys(text)
    ok = parsed.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0)
    for name in names:
        ok &= parsed[name].isNotNull()
    for name, values in (enums or {}).items():
        ok &= parsed[name].isin(*values)
    return F.coalesce(ok, F.lit(False))


def parse_json(rows: DataFrame, text: str, schema: str, into: str, enums: dict[str, tuple] | None = None) -> DataFrame:
    """rows with the parsed struct, null where the text doesn't fit, and <into>_valid."""
    ok = valid_json(F.col(text), schema, enums)
    return rows.withColumn(f"{into}_valid", ok).withColumn(into, F.when(F.col(f"{into}_valid"), F.from_json(F.col(text), schema)))


def _fields(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fields


def fits(value, kind) -> bool:
    """Whether a value read from JSON is of a Spark type: an object has exactly the type's fields, nothing is null, a whole
    number may stand for a double, a truth value never for a number."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and set(value) == set(kind.names) and all(fits(value[f.name], f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(fits(v, kind.elementType) for v in value)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    return not isinstance(value, bool) and isinstance(value, int if isinstance(kind, T.IntegralType) else (int, float))
