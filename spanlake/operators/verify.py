"""The boundary to models: verification and boundary refinement around a backend that fakes can stand in for."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from spanlake.operators.evidence import KEYS
from spanlake.operators.folds import deduplicate
from spanlake.operators.windows import boundary_probes, verifier_windows
from spanlake.schema import fits
from spanlake.sources.scratch import materialize


class ModelBackend(Protocol):
    """What the engine asks of models. Implementations are pickled to the workers; a method gets one batch of rows."""

    def plan(self, queries: pd.Series) -> pd.Series: ...  # JSON of schema.PLAN
    def embed_text(self, texts: pd.Series, task: str) -> pd.Series: ...  # vectors
    def describe(self, rows: pd.DataFrame) -> pd.Series: ...  # JSON of schema.SCENE
    def verify(self, rows: pd.DataFrame) -> pd.Series: ...  # lists of instances, seconds from the window's start
    def confirm(self, rows: pd.DataFrame) -> pd.DataFrame: ...  # valid, confidence, start_seconds, end_seconds
    def boundary(self, rows: pd.DataFrame) -> pd.DataFrame: ...  # contains_boundary, confidence, boundary_seconds
    def scan(self, rows: pd.DataFrame) -> pd.Series: ...  # JSON of schema.OCR_SCAN, seconds from the window's start
    def read_frames(self, rows: pd.DataFrame) -> pd.Series: ...  # JSON of schema.OCR_FRAME, one reading for each time in `times`
    def read_crops(self, rows: pd.DataFrame) -> pd.Series: ...  # JSON of schema.OCR_CROP, one reading for each box in `crops`
    def sharpness(self, rows: pd.DataFrame) -> pd.Series: ...  # of the crop `bbox` at `timestamp`
    def transcribe(self, rows: pd.DataFrame) -> pd.Series: ...  # JSON of schema.SPEECH; no words for a file without sound


#: Prefixes that a text embedder takes for its two tasks.
TASKS = {"document": "search_document: ", "query": "search_query: "}
INSTANCES = "array<struct<start_seconds:double,end_seconds:double,confidence:double,description:string,actor_description:string,visual_evidence:string>>"


def with_retries(call: Callable, attempts: int = 3, pause: float = 0.0):
    """call's result; after the last failed attempt its error. Pauses grow twofold."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(pause * 2**n)


def answered(call: Callable[[pd.DataFrame], pd.DataFrame | pd.Series], rows: pd.DataFrame, attempts: int = 3, pause: float = 0.5) -> tuple[pd.DataFrame, list]:
    """The rows that the model answers and its answers: a batch that fails is asked row by row, and a row that still fails goes."""
    try:
        return rows, [with_retries(lambda: call(rows), attempts, pause)]
    except Exception:
        kept, said = [], []
        for i in range(len(rows)):
            one = rows.iloc[i : i + 1]
            try:
                said.append(with_retries(lambda one=one: call(one), attempts, pause))
                kept.append(one)
            except Exception:
                logging.getLogger(__name__).warning("a row was left out: the model gave no answer", exc_info=True)
        return pd.concat(kept) if kept else rows.iloc[:0], said


def tried(ask: Callable[[pd.DataFrame], pd.Series], rows: pd.DataFrame) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each row: a batch that fails is asked row by row, so that one bad row costs no other its answer."""
    try:
        return [(a, None) for a in ask(rows)]
    except Exception as e:
        if len(rows) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [tried(ask, rows.iloc[i : i + 1])[0] for i in range(len(rows))]


def json_answers(rows: DataFrame, ask: Callable[[pd.DataFrame], pd.Series], schema: str, into: str, enums: dict[str, tuple] | None = None, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """rows with the model's JSON answer as a struct of the schema, and `error`. Rows without an answer, or whose answer does
    not fit the schema, are asked again after growing pauses; after the last attempt the struct is null and error says why."""
    kind = _parse_datatype_string(schema)
    told = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{into}` string, error string"

    def wrong(text: str | None) -> str | None:
        try:
            value = json.loads(text or "")
        except ValueError:
            return "the answer is no JSON"
        good = fits(value, kind) and all(value[name] in allowed for name, allowed in (enums or {}).items())
        return None if good else "the answer does not fit its schema"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said: list = [(None, None)] * len(b)
            todo = list(range(len(b)))
            for n in range(attempts):
                if not todo:
                    break
                time.sleep(pause * 2 ** (n - 1) if n else 0)
                for i, (text, error) in zip(todo, tried(ask, b.iloc[todo]), strict=True):
                    said[i] = (text, error or wrong(text))
                todo = [i for i in todo if said[i][1]]
            yield b.assign(**{into: [None if e else t for t, e in said], "error": [e for _, e in said]})

    # answers are written: what uses them several times, or again after a lost executor, does not ask the model again
    return materialize(rows.mapInPandas(run, told)).withColumn(into, F.from_json(into, schema))


def _unit(x) -> list[float]:
    import numpy as np

    n = np.linalg.norm(x)
    return (x / n if n > 0 else x).tolist()


def _embedded(rows: DataFrame, text: str, into: str, run: Callable[[list[str]], list]) -> DataFrame:
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{into}` array<double>"

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            yield b.assign(**{into: run([t or "" for t in b[text]])})

    return rows.mapInPandas(batches, schema)


def embed_texts(rows: DataFrame, backend: ModelBackend, text: str = "text", task: str = "document", into: str = "vec") -> DataFrame:
    """rows with a unit vector each, of the whole text with its task's prefix."""
    import numpy as np

    return _embedded(rows, text, into, lambda texts: [_unit(np.asarray(v, float)) for v in with_retries(lambda: backend.embed_text(pd.Series([TASKS[task] + t for t in texts]), task))])


def embed_visual_texts(rows: DataFrame, backend: ModelBackend, text: str = "text", into: str = "vec", words: int = 40) -> DataFrame:
    """rows with a unit vector each for the space of frames: texts without prefix, long ones in pieces of so many words, averaged."""
    import numpy as np

    def run(texts: list[str]) -> list:
        split = [t.split() for t in texts]
        pieces = [[" ".join(w[i : i + words]) for i in range(0, max(1, len(w)), words)] for w in split]
        vectors = iter(with_retries(lambda: backend.embed_text(pd.Series([x for each in pieces for x in each]), "visual")))
        return [_unit(np.mean([np.asarray(next(vectors), float) for _ in each], axis=0)) for each in pieces]

    return _embedded(rows, text, into, run)


def verify_candidates(candidates: DataFrame, backend: ModelBackend, keys: list[str] = KEYS, window: float = 25.0, overlap: float = 5.0, floor: float = 0.10) -> DataFrame:
    """First pass: each window of each candidate (start, end, duration) is shown to the model; its instances of enough
    confidence, in the recording's time and held to its length, without repeats in and between candidates."""
    shown = verifier_windows(candidates.select(*keys, "candidate_id", "start", "end", "duration"), window, overlap).drop("idx")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in shown.schema.fields)}, found {INSTANCES}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept, said = answered(backend.verify, b)
            yield kept.assign(found=[x for part in said for x in part])

    # answers are written: what uses them several times, or again after a lost executor, does not ask the model again
    each = materialize(shown.mapInPandas(run, schema)).withColumn("i", F.explode("found"))
    hits = each.where(F.col("i.confidence") >= floor).select(
        *keys, "candidate_id", F.greatest(F.lit(0.0), F.col("start") + F.col("i.start_seconds")).alias("start"), F.least("duration", F.col("start") + F.col("i.end_seconds")).alias("end"),
        "i.confidence", "i.description", "i.actor_description", "i.visual_evidence",
    )
    own = deduplicate(hits.where("end > start"), [*keys, "candidate_id"])
    return deduplicate(own, keys)


def confirm_instances(instances: DataFrame, backend: ModelBackend, keys: list[str] = KEYS, padding: float = 5.0, floor: float = 0.25, limit: float = 0.70) -> DataFrame:
    """Second pass: each instance (with duration) is shown with some padding; those called valid with enough confidence stay,
    with the bounds that the model gave."""
    shown = instances.withColumns({"window_start": F.greatest(F.lit(0.0), F.col("start") - padding), "window_end": F.least("duration", F.col("end") + padding)})
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in shown.schema.fields)}, valid boolean, pro_confidence double, start_seconds double, end_seconds double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b, said = answered(backend.confirm, b)
            got = pd.concat(said, ignore_index=True) if said else pd.DataFrame(columns=["valid", "confidence", "start_seconds", "end_seconds"])
            yield pd.concat([b.reset_index(drop=True), got.rename(columns={"confidence": "pro_confidence"})[["valid", "pro_confidence", "start_seconds", "end_seconds"]]], axis=1)

    said = materialize(shown.mapInPandas(run, schema)).where(F.col("valid") & (F.col("pro_confidence") >= floor) & (F.col("start_seconds") >= 0) & (F.col("end_seconds") > F.col("start_seconds")))
    at = lambda c: F.col("window_start") + F.col(c)
    kept = said.withColumns({"start": F.greatest(F.lit(0.0), at("start_seconds")), "end": F.least("duration", at("end_seconds")), "confidence": F.col("pro_confidence")}).where("end > start")
    return deduplicate(kept.select(*[c for c in instances.columns]).withColumn("pro_verified", F.lit(True)), keys, limit)


def pick_boundary(probes: DataFrame, key: list[str], floor: float = 0.45) -> DataFrame:
    """The estimate of the most confident valid probe (probe_start, probe_end, contains_boundary, confidence, boundary_seconds)
    of each key, the earlier of equals."""
    inside = (F.col("boundary_seconds") >= 0) & (F.col("boundary_seconds") <= F.col("probe_end") - F.col("probe_start"))
    valid = probes.where(F.col("contains_boundary") & (F.col("confidence") >= floor) & inside)
    return valid.groupBy(*key).agg(F.max_by(F.col("probe_start") + F.col("boundary_seconds"), F.struct("confidence", -F.col("probe_start"))).alias("new_estimate"))


def refine_boundaries(instances: DataFrame, backend: ModelBackend, row_id: str, sizes: tuple[float, ...] = (8.0, 4.0, 2.0)) -> DataFrame:
    """instances (row_id, start, end, duration) with both bounds moved to where probes of falling size find them; both stay as
    they were if they would cross. Adds boundary_refined."""
    ends = instances.select(row_id, "duration", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("estimate")), F.struct(F.lit("end").alias("side"), F.col("end").alias("estimate")))).alias("b"))
    state = ends.select(row_id, "duration", "b.side", "b.estimate")
    for size in sizes:
        probes = boundary_probes(state, size)
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in probes.schema.fields)}, contains_boundary boolean, confidence double, boundary_seconds double"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b, said = answered(backend.boundary, b)
                got = pd.concat(said, ignore_index=True) if said else pd.DataFrame(columns=["contains_boundary", "confidence", "boundary_seconds"])
                yield pd.concat([b.reset_index(drop=True), got[["contains_boundary", "confidence", "boundary_seconds"]]], axis=1)

        chosen = pick_boundary(materialize(probes.mapInPandas(run, schema)), [row_id, "side"])
        state = state.join(chosen, [row_id, "side"], "left").withColumn("estimate", F.coalesce("new_estimate", "estimate")).drop("new_estimate")
    moved = state.groupBy(row_id).agg(F.max(F.when(F.col("side") == "start", F.col("estimate"))).alias("__s"), F.max(F.when(F.col("side") == "end", F.col("estimate"))).alias("__e"))
    good = F.col("__e") > F.col("__s")
    both = instances.join(moved, row_id)
    changed: Column = good & ((F.col("__s") != F.col("start")) | (F.col("__e") != F.col("end")))
    return both.withColumns({"boundary_refined": changed, "start": F.when(good, F.col("__s")).otherwise(F.col("start")), "end": F.when(good, F.col("__e")).otherwise(F.col("end"))}).drop("__s", "__e")


def best_only(detections: DataFrame, keys: list[str] = KEYS, score: str = "confidence") -> DataFrame:
    """The most confident detection of each query, the earlier of equals."""
    rest = [c for c in detections.columns if c not in keys]
    best = detections.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col("start"))).alias("__b"))
    return best.select(*keys, "__b.*")
