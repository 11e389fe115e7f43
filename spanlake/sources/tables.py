"""Sources and sinks: JSON lines, manifests, index folders with a commit marker, resumable output, the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.intervals import format_timestamp_precise, query_folder
from spanlake.sources.scratch import materialize

#: Version of the index layout; extensions of files that are taken in.
INDEX_VERSION = 6
EXTENSIONS = ("mp4", "m4v", "mov", "mkv", "webm", "avi")


class IndexVersionMismatch(RuntimeError):
    """An index that another version wrote."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each well-formed line; others are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each element of a JSON array or each object of its own lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_sorted_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """Words or segments as JSON lines, in order within and between files."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def nest_manifest(videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """One manifest document for each video: the video's fields and its chunks by scale, in order."""
    item = F.struct("idx", "chunk_id", "start", "end", "duration", "relative_path")
    scales = chunks.groupBy("video_id", "scale").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    nested = scales.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("scale", "chunks"))).alias("scales"))
    return videos.join(nested, "video_id", "left")


def flatten_manifest(manifests: DataFrame) -> DataFrame:
    """The chunks table of manifest documents."""
    each = manifests.select("video_id", F.explode("scales").alias("scale", "chunks"))
    return each.select("video_id", "scale", F.explode("chunks").alias("c")).select("video_id", "scale", "c.*")


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key is not in done."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def append_resumable(rows: DataFrame, path: str, key: list[str], work: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """Do the work for rows that the JSON lines at path don't have yet and append it; returns the rows that failed.

    work returns its rows with an `error` column: those with an error are returned, the others are appended."""
    spark = rows.sparkSession
    key_schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    todo = pending(rows, read_jsonl(spark, path, key_schema), key) if there else rows
    if most is not None:
        todo = todo.orderBy(*key).limit(most)
    results = materialize(work(todo))
    results.where("error is null").drop("error").write.mode("append").json(path)
    return results.where("error is not null")


def write_index(tables: dict[str, DataFrame], folder: str, signature: str) -> None:
    """Tables as Parquet, and the marker last: a folder without it was never finished."""
    for name, rows in tables.items():
        by = ["scale"] if "scale" in rows.columns else []
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = [(name, spark.read.parquet(f"{folder}/{name}").count(), INDEX_VERSION, signature) for name in tables]
    spark.createDataFrame(counts, "table_name string, n long, version int, signature string").coalesce(1).write.mode("overwrite").json(f"{folder}/ready")


def load_index(spark: SparkSession, folder: str, signature: str | None = None, version: int = INDEX_VERSION) -> dict[str, DataFrame]:
    """The tables of a finished index of this version, and of this signature if one is given."""
    marker = spark.read.schema("table_name string, n long, version int, signature string").json(f"{folder}/ready").collect()
    if not marker or any(r["version"] != version for r in marker):
        raise IndexVersionMismatch(f"{folder} was not written as version {version}")
    if signature is not None and any(r["signature"] != signature for r in marker):
        raise IndexVersionMismatch(f"{folder} was made with other settings")
    return {r["table_name"]: spark.read.parquet(f"{folder}/{r['table_name']}") for r in marker}


def index_key(rows: DataFrame, settings: str = "settings", size: str = "size", modified: str = "modified") -> DataFrame:
    """index_key: 16 hex digits from the settings that change an index, the file's size and its time."""
    return rows.withColumn("index_key", F.substring(F.sha2(F.concat_ws("|", settings, size, modified), 256), 1, 16))


def file_key(path: Column, size: Column, modified: Column, *settings: Column) -> Column:
    """24 hex digits for what was made of a file: they change with its path, size, time and the settings."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), modified.cast("string"), *[s.cast("string") for s in settings]), 256), 1, 24)


def ingest(files: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Library records of files (path, content, duration, has_video): named by their content, so the same bytes are one
    record whatever the name; other extensions and files without a picture or length are left out."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    good = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*EXTENSIONS) & F.col("has_video") & (F.col("duration") > 0) & (F.col("duration") < float("inf"))
    ids = files.where(good).select(F.substring(F.sha2("content", 256), 1, 16).alias("video_id"), name.alias("name"), "path", F.octet_length("content").cast("long").alias("size"), "duration")
    w = Window.partitionBy("video_id").orderBy("path")
    fresh = ids.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return fresh if library is None else fresh.join(library.select("video_id"), "video_id", "left_anti")


def media_scan(spark: SparkSession, path: str, probe: Callable[[bytes], dict]) -> DataFrame:
    """Files with what a probe tells of each: path, content, duration (0 if it can't be told), has_video."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [probe(bytes(x)) for x in b["content"]]
            yield b.assign(duration=[float(g.get("duration") or 0) for g in got], has_video=[bool(g.get("has_video")) for g in got])

    return files.mapInPandas(run, "path string, content binary, duration double, has_video boolean")


def recover_records(records: DataFrame, indexed: DataFrame) -> DataFrame:
    """Records left over by a stopped run: indexing ones are ready if their index is there, else interrupted."""
    known = records.join(indexed.select("video_id", F.lit(True).alias("__there")), "video_id", "left")
    status = F.when(F.col("status").isin("queued", "indexing"), F.when(F.col("__there"), "ready").otherwise("interrupted")).otherwise(F.col("status"))
    return known.withColumn("status", status).drop("__there")


def recover_searches(searches: DataFrame) -> DataFrame:
    return searches.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("created_at"))


def number_matches(detections: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """Detections in order of time (and of the columns in ties), numbered from 0, with written times."""
    w = Window.partitionBy(*keys).orderBy("start", "end", *ties)
    named = detections.withColumn("match_id", (F.row_number().over(w) - 1).cast("long"))
    return named.withColumns({"start_timestamp": format_timestamp_precise(F.col("start")), "end_timestamp": format_timestamp_precise(F.col("end"))})


def write_matches(matches: DataFrame, path: str, query: str = "query") -> None:
    """Matches as JSON, in a folder for each query."""
    matches.withColumn("query_folder", query_folder(F.col(query))).write.mode("overwrite").partitionBy("query_folder").json(path)


def publish(results: DataFrame, root: str = "", base: str = "/files/", limit: int = 720) -> DataFrame:
    """Results as others may see them, at every depth: results_file, initial_candidates and top_evidence_bins go, `path` and
    `*_path` become `url` and `*_url` under base (null, and so absent from JSON, where a path leaves root), candidates keep
    start, end and score, and an evidence_map longer than limit is drawn together. root "" takes relative paths only."""
    return results.select(*[c.alias(name) for name, c in _public(results.schema, lambda n: F.col(f"`{n}`"), root.rstrip("/"), base, limit)])


def _address(path: Column, root: str, base: str) -> Column:
    inside = path if not root else F.when(path.startswith(f"{root}/"), F.substring(path, F.lit(len(root) + 2), F.length(path)))
    outside = inside.startswith("/") | inside.rlike(r"(^|/)\.\.(/|$)") | (inside == "")
    return F.when(~outside, F.concat(F.lit(base), inside))


def _public(kind: T.StructType, field: Callable[[str], Column], root: str, base: str, limit: int) -> list[tuple[str, Column]]:
    out = []
    for f in kind.fields:
        value, many = field(f.name), isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        if f.name in ("results_file", "initial_candidates", "top_evidence_bins"):
            continue
        if isinstance(f.dataType, T.StringType) and (f.name == "path" or f.name.endswith("_path")):
            out.append((f"{f.name[:-4]}url", _address(value, root, base)))
        elif many and f.name == "candidates":
            out.append((f.name, _fields_of(value, [n for n in ("start", "end", "score") if n in f.dataType.elementType.names])))
        elif many and f.name == "evidence_map":
            out.append((f.name, _drawn_together(value, f.dataType.elementType, limit)))
        else:
            out.append((f.name, _public_value(value, f.dataType, root, base, limit)))
    return out


def _public_value(value: Column, kind: T.DataType, root: str, base: str, limit: int) -> Column:
    if isinstance(kind, T.StructType):
        inner = [c.alias(name) for name, c in _public(kind, lambda n: value[n], root, base, limit)]
        return F.when(value.isNotNull(), F.struct(*inner)) if inner else F.lit(None)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        return F.transform(value, lambda x: _public_value(x, kind.elementType, root, base, limit))
    return value


def _fields_of(rows: Column, names: list[str]) -> Column:
    return F.transform(rows, lambda x: F.struct(*[x[n].alias(n) for n in names]))


def _greatest(rows: Column, name: str) -> Column:
    return F.array_max(F.transform(rows, lambda x: x[name]))


def _drawn_together(bins: Column, kind: T.StructType, limit: int) -> Column:
    """At most limit bins: runs of equal number with the first start, the last end and the greatest of every other number."""
    step = F.greatest(F.lit(1), F.ceil(F.size(bins) / F.lit(limit))).cast("int")
    of = {"start": lambda run: run[0]["start"], "end": lambda run: F.element_at(run, -1)["end"]}
    names = [f.name for f in kind.fields if isinstance(f.dataType, T.NumericType)]
    one = lambda run: F.struct(*[(of[n](run) if n in of else _greatest(run, n)).alias(n) for n in names])
    runs = F.transform(F.sequence(F.lit(1), F.size(bins), step), lambda i: one(F.slice(bins, i, step)))
    return F.when(F.size(bins) > 0, runs).when(bins.isNotNull(), F.array().cast(T.ArrayType(T.StructType([f for f in kind.fields if f.name in names]))))
