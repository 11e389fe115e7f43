"""Query plans as rows: a plan struct is cleaned by expressions, then flattened into tables of specs, rules and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of a plan.
DEFAULT_WEIGHTS = {"video": 0.5, "metadata": 0.5, "transcript_semantic": 0.0, "transcript_bm25": 0.0}
MODALITIES = ("video", "metadata", "transcript_semantic", "transcript_bm25")
DEFAULT_MODALITIES = ("video", "metadata")
QUERY_LISTS = {"video": "visual_queries", "metadata": "metadata_queries", "transcript_semantic": "transcript_queries", "transcript_bm25": "transcript_queries"}
TARGET_DEFAULTS = {
    "target_object": "visible text-bearing region",
    "target_region": "text region",
    "text_description": "visible text",
    "extraction_instruction": "Read the visible text relevant to the user query exactly.",
}
TEXT_EXECUTOR = "visual_text_extraction"


def _array(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def _filled(text: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def normalize_weights(weights: dict[str, Column]) -> dict[str, Column]:
    """Weights clamped to 0 or more and divided by their sum; the defaults where the sum is 0."""
    clamped = {k: F.greatest(F.lit(0.0), F.coalesce(w.cast("double"), F.lit(0.0))) for k, w in weights.items()}
    total = sum(clamped.values(), F.lit(0.0))
    return {k: F.when(total > 0, w / total).otherwise(F.lit(DEFAULT_WEIGHTS.get(k, 0.0))) for k, w in clamped.items()}


def clean_predicates(predicates: Column) -> Column:
    """Trimmed, blank ones and later ones of the same text (any case) dropped; defaults filled in, importance held to [0, 1]."""
    named = F.transform(
        predicates,
        lambda p, i: F.struct(
            F.coalesce(_filled(p["id"]), F.concat(F.lit("evidence_"), i.cast("string"))).alias("id"),
            F.trim(p["description"]).alias("description"),
            F.coalesce(_filled(p["role"]), F.lit("cue")).alias("role"),
            F.filter(F.coalesce(p["modalities"], F.array().cast("array<string>")), lambda m: m.isin(*MODALITIES)).alias("modalities"),
            F.coalesce(p["required"], F.lit(False)).alias("required"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p["importance"], F.lit(0.5)))).alias("importance"),
        ),
    )
    full = F.filter(named, lambda p: F.length(F.coalesce(p["description"], F.lit(""))) > 0)
    texts = F.transform(full, lambda p: F.lower(p["description"]))
    first = F.filter(full, lambda p, i: F.array_position(texts, F.lower(p["description"])) == i + 1)
    return F.transform(first, lambda p: p.withField("modalities", F.when(F.size(p["modalities"]) > 0, p["modalities"]).otherwise(_array(*DEFAULT_MODALITIES))))


def clean_rules(rules: Column, ids: Column) -> Column:
    """Ordering rules whose two ids are known and different."""
    return F.filter(rules, lambda r: F.array_contains(ids, r["first"]) & F.array_contains(ids, r["then"]) & (r["first"] != r["then"]))


def clean_plan(rows: DataFrame, plan: str = "plan", query: str = "query") -> DataFrame:
    """rows with the plan struct (schema.PLAN) made ready: a plan that reads on-screen text keeps its target fields, with
    defaults, and searches nothing else; any other keeps its searches and blanks the target fields."""
    p = F.col(plan)
    text = F.coalesce(p["executor"] == TEXT_EXECUTOR, F.lit(False))
    empty = lambda name: F.array().cast(rows.schema[plan].dataType[name].dataType)
    predicates = clean_predicates(F.coalesce(p["evidence_predicates"], empty("evidence_predicates")))
    rules = clean_rules(F.coalesce(p["ordering"], empty("ordering")), F.transform(predicates, lambda x: x["id"]))
    nonblank = lambda x: F.filter(F.transform(x, lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    new = p.withField("target_event", F.when(text, F.coalesce(_filled(p["target_event"]), F.col(query))).otherwise(p["target_event"]))
    for name, default in TARGET_DEFAULTS.items():
        new = new.withField(name, F.when(text, F.coalesce(_filled(p[name]), F.lit(default))).otherwise(F.lit("")))
    for name in ("visual_queries", "metadata_queries", "transcript_queries"):
        new = new.withField(name, F.when(text, empty(name)).otherwise(p[name]))
    for name in ("negative_evidence", "temporal_constraints"):
        new = new.withField(name, F.when(text, empty(name)).otherwise(nonblank(F.coalesce(p[name], empty(name)))))
    new = new.withField("evidence_predicates", F.when(text, empty("evidence_predicates")).otherwise(predicates))
    new = new.withField("ordering", F.when(text, empty("ordering")).otherwise(rules))
    for name, w in normalize_weights({k: p["weights"][k] for k in MODALITIES}).items():
        new = new.withField(f"weights.{name}", F.when(text, F.lit(0.0)).otherwise(w))
    return rows.withColumn(plan, new)


def dedupe_specs(specs: DataFrame, keys: list[str]) -> DataFrame:
    """Of specs (keys, position, query, importance, ...) with the same trimmed query in any case, the most important one (the
    first of equals), in the first one's position; blank ones go."""
    rest = [c for c in specs.columns if c not in (*keys, "position")]
    named = specs.withColumn("query", F.trim("query")).where(F.length("query") > 0)
    best = named.groupBy(*keys, F.lower("query").alias("__q")).agg(F.min("position").alias("position"), F.max_by(F.struct(*rest), F.struct("importance", -F.col("position"))).alias("__b"))
    return best.select(*keys, "position", *[F.col(f"__b.{c}").alias(c) for c in rest])


def query_specs(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """query_id, channel, ranking, query, predicate_id, role, required, importance, weight of every search a plan asks for.

    A channel's own queries come first, then the predicates that name it, without repeats; channels of weight 0 are left out.
    Negative evidence is searched in video and metadata whatever the weights are, as rankings of the channel `negative`."""
    p = F.col(plan)
    found = None
    for channel in MODALITIES:
        own = F.transform(p[QUERY_LISTS[channel]], lambda q: F.struct(q.alias("query"), F.lit("planner_query").alias("predicate_id"), F.lit("target").alias("role"), F.lit(True).alias("required"), F.lit(1.0).alias("importance")))
        cues = F.transform(
            F.filter(p["evidence_predicates"], lambda x: F.array_contains(x["modalities"], F.lit(channel))),  # noqa: B023  (called here and now)
            lambda x: F.struct(x["description"].alias("query"), x["id"].alias("predicate_id"), x["role"].alias("role"), x["required"].alias("required"), x["importance"].alias("importance")),
        )
        each = plans.where(p["weights"][channel] > 0).select("query_id", F.lit(channel).alias("channel"), p["weights"][channel].alias("weight"), F.posexplode(F.concat(own, cues)).alias("position", "s"))
        flat = each.select("query_id", "channel", "weight", "position", "s.*")
        found = flat if found is None else found.unionByName(flat)
    deduped = dedupe_specs(found, ["query_id", "channel"])
    negatives = plans.select("query_id", F.posexplode(p["negative_evidence"]).alias("n", "query")).select("query_id", "query", "n", F.explode(_array("video", "metadata")).alias("searched"))
    place = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("position")) - 1
    out = deduped.withColumn("ranking", place).withColumn("searched", F.col("channel")).drop("position")
    side = F.when(F.col("searched") == "video", 0).otherwise(1)
    neg = negatives.select("query_id", F.lit("negative").alias("channel"), F.lit(0.0).alias("weight"), "query", F.concat(F.lit("negative_"), F.col("n")).alias("predicate_id"), F.lit("negative").alias("role"), F.lit(False).alias("required"), F.lit(1.0).alias("importance"), (2 * F.col("n") + side).cast("int").alias("ranking"), "searched")
    return out.unionByName(neg)


def run_specs(specs: DataFrame, searches: dict, top_k: int = 200) -> DataFrame:
    """All rankings of all specs: searches maps a channel to f(queries with query_id and query, k) -> hits with query_id,
    video_id, chunk_id, start, end, score, rank. A channel without a search is skipped. One batch for each channel."""
    keyed = specs.withColumn("__spec", F.concat_ws("|", "query_id", "channel", "ranking", "searched"))
    found = None
    for channel, search in searches.items():
        mine = keyed.where(F.col("searched") == channel)
        hits = search(mine.select(F.col("__spec").alias("query_id"), "query"), top_k).withColumnRenamed("query_id", "__spec")
        rows = hits.join(mine, "__spec").drop("__spec", "searched", "weight")
        found = rows if found is None else found.unionByName(rows)
    return found


def search_options(mode: str = "verified", min_confidence: float = 0.25, max_candidates: int | None = None, query: str = "", refine: bool = True) -> dict:
    """A search's options checked: query of 1 to 500 signs with single spaces; ValueError says what is wrong."""
    query = " ".join(query.split())
    most = {"verified": 20, "quick": 12}
    if not 1 <= len(query) <= 500:
        raise ValueError("the query must have 1 to 500 characters")
    if mode not in most:
        raise ValueError("the mode must be verified or quick")
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be from 0 to 1")
    count = most[mode] if max_candidates is None else int(max_candidates)
    if not 1 <= count <= 50:
        raise ValueError("max_candidates must be from 1 to 50")
    return {"query": query, "mode": mode, "min_confidence": float(min_confidence), "max_candidates": count, "refine": bool(refine)}
