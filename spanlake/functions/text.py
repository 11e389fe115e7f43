"""Text expressions; only Unicode normalisation and the matching-blocks ratio need Python, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell nothing about who acts.
GENERIC_ACTORS = (
    "person", "people", "man", "woman", "male", "female", "adult", "individual", "someone",
    "the", "a", "an", "in", "wearing", "with", "on", "near", "standing", "visible",
)
#: Labels of a scene's lists in its search text.
SCENE_LISTS = (
    ("people", "People"), ("objects", "Objects"), ("actions", "Actions"), ("interactions", "Interactions"), ("motion_events", "Motion"),
    ("state_changes", "State changes"), ("visible_text", "Visible text"), ("search_terms", "Search terms"),
)


def tokenize(text: Column) -> Column:
    """Runs of letters, digits and '_' of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def comparison_key(text: Column) -> Column:
    """Upper case, letters and digits only (text already in composed form)."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def answer_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def normalized_ocr(text: str | None) -> str:
    """Compatibility composition, no NUL, single spaces, trimmed."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").replace("\0", " ").strip())


def reading_key(text: str | None) -> str:
    return "".join(filter(str.isalnum, normalized_ocr(text).upper()))


def reading_similarity(a: str | None, b: str | None) -> float:
    """Ratio of matching blocks of two readings' keys; keys of one or two signs must be equal."""
    x, y = reading_key(a), reading_key(b)
    if not x or not y:
        return 0.0
    return float(x == y) if min(len(x), len(y)) <= 2 else SequenceMatcher(None, x, y).ratio()


def normalize_ocr(text: Column) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return text.map(normalized_ocr)

    return F.pandas_udf(run, "string")(text)


def text_similarity(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([reading_similarity(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def actor_signature(text: Column) -> Column:
    """The telling words of a description."""
    words = F.regexp_extract_all(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, GENERIC_ACTORS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def scene_text(scene: dict[str, Column], events: Column | None = None) -> Column:
    """The text by which a described scene is searched: labelled lines, those without content left out."""
    line = lambda label, x: F.when(F.length(F.coalesce(x, F.lit(""))) > 0, F.concat(F.lit(f"{label}: "), x))
    lines = [line("Summary", scene["summary"]), line("Scene", scene["scene"])]
    lines += [line(label, F.array_join(scene[name], "; ")) for name, label in SCENE_LISTS if name in scene]
    if events is not None:
        lines.append(line("Important events", F.array_join(F.transform(events, lambda e: e["description"]), "; ")))
    return F.concat_ws("\n", *lines)


def event_text(event: Column, counts: Column, not_counts: Column, required: Column, optional: Column) -> Column:
    """The event's definition for a verifier, a paragraph for each part that has content; the last four are arrays."""
    part = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{label}:\n- "), F.array_join(x, "\n- ")))
    head = F.when(F.length(F.coalesce(event, F.lit(""))) > 0, F.concat(F.lit("Target event: "), event))
    return F.concat_ws("\n\n", head, part("Counts as a match", counts), part("Does not count", not_counts), part("Required evidence", required), part("Supporting evidence", optional))
