"""What the corpus operators share: scratch tables, size-checked broadcasts and byte-level words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.sources.scratch import give_back, materialize, scratch_dir  # noqa: F401

#: The white space that ends a word, as bytes.split() has it too (\x20 \x09-\x0D).
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def broadcast_under(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; otherwise df, which joins by shuffle.

    df should be cheap to count: a materialized table or a small aggregate.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after limiting the bytes of a batch between the JVM and a Python worker where the session has no limit of its own:
    the default of 64 MB is held several times over in both, for every core of an executor."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df


def giving_back(run):
    """run (batches to batches, for mapInArrow), after which the worker hands the memory it no longer uses back to the system:
    workers wait for more tasks while the JVM works, and would else keep the most they ever had."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """df with a long that tells equal rows apart and is the same at every reading: a hash of file and row number.

    A frame that is not a plain scan of files is written to the shared folder first. Other columns, whatever their names,
    stay as they are."""
    try:
        meta = df.metadataColumn("_metadata")
        return df.withColumn(name, F.xxhash64(meta["file_path"], meta["row_index"]))
    except AnalysisException:
        df = materialize(df)
        meta = df.metadataColumn("_metadata")
        return df.withColumn(name, F.xxhash64(meta["file_path"], meta["row_index"]))


def packed(*columns):
    """Rows of signed longs as byte strings in the same order, for binary search on several columns at once."""
    import numpy as np

    wide = np.stack([(np.asarray(c, np.int64) ^ np.int64(-(2**63))).view(np.uint64) for c in columns], axis=1).astype(">u8")
    return np.ascontiguousarray(wide).view(f"S{8 * len(columns)}").ravel()


def place_of(spark: SparkSession, keys, side: str = "left"):
    """A function of three long columns: how many of the sorted packed keys are below them (side right: or equal)."""
    shared = spark.sparkContext.broadcast(keys)

    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array(np.searchsorted(shared.value, packed(a, b, c), side=side), pa.int64())

    return F.arrow_udf(run, "long")


def sampled_keys(rows: DataFrame, columns: list[str], weight: str, rate: float, salt: int):
    """(packed keys, weights) in key order of rows drawn with a chance of weight * rate, by a hash, so that reruns agree.
    A row that was not sure to be drawn weighs 1 / rate."""
    import numpy as np

    u = F.xxhash64(*columns, F.lit(salt)).cast("double") / F.lit(2.0**64) + 0.5
    got = rows.where(u < F.col(weight) * F.lit(float(rate))).select(*columns, weight).toArrow()
    keys = packed(*[got.column(c).to_numpy() for c in columns])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.maximum(got.column(weight).to_numpy().astype(float), 1 / rate)[order]


def quantile_keys(keys, weights, parts: int):
    """At most parts - 1 of the keys, which cut them into parts of near equal weight."""
    import numpy as np

    if not len(keys) or parts < 2:
        return keys[:0]
    sums = np.cumsum(weights)
    at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


class WordHashes(dict):
    """64-bit hashes of words, computed once each and forgotten together when there are too many."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
