"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are the shares of its hashed word uni- and bigrams, and of the uni- and bigrams of the words' shapes
(runs of upper-case, lower-case and digit characters as one sign, marks as themselves) and of words that repeat the one
before. A score is the sparse dot product of these with the weights, as a probability of label 1.

The classifier learns from about `sample` different labelled texts at most, drawn by a hash of id and text (a bounded fit: rows
that repeat an id, a text and a label are one). Labels meet ids and hashes of texts only, so the sample's texts are all that is
shuffled; features of the sample are made on the executors, at most one number for each of the 2^BITS, and read one after
another. Every text is scored whole; the weights are one vector of fixed size.

Defined results: a null or blank text has the bias as its only feature; ids without label or with a null or other label
are scored only; an id with both labels is learnt with both; without any label every score is 0.5; null ids are scored;
repeated rows get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import residue, table

#: Fixed values of the contract: rows with remainder 0 are held out; scores from here on count as label 1.
MODULUS, HELD_OUT, LIMIT = 5, 0, 0.3
BITS, SAMPLE, EPOCHS = 18, 8_000, 3
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.02, 1.0, 20.0
_RUN = re.compile(rb"(.)\1+", re.S)


class Shapes(dict):
    """word -> hash of the word (upper 32 bits) and of its shape (lower 32 bits)."""

    most = 300_000
    signs = bytes(97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(self.signs))
        self[word] = value = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape)
        return value


def indexes(text: bytes | None, shapes: Shapes):
    """Feature numbers, one for each occurrence, and the number of words."""
    import numpy as np

    words = (text or b"").split()
    n = len(words)
    if not n:
        return np.empty(0, np.int32), 0
    both = np.fromiter(map(shapes.__getitem__, words), np.uint64, n)
    word, shape = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    a, b = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
    same = np.full(int((word[1:] == word[:-1]).sum()), 0x5BD1E995, np.uint32)
    parts = [word * a, shape * b + np.uint32(1), (word[:-1] * a ^ word[1:]) * b + np.uint32(2), (shape[:-1] * b ^ shape[1:]) * a + np.uint32(3), same]
    return (np.concatenate(parts) >> np.uint32(32 - BITS)).astype(np.int32), n


def ftrl(rows: list, epochs: int = EPOCHS):
    """Weights (the bias is the last) from rows (label, feature numbers, counts, words) by per-coordinate updates."""
    import numpy as np

    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full(len(z), L1)
    l1[-1] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0, -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2 * (i != len(z) - 1)))

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            label, index, count, words = rows[r]
            i = np.append(index, len(z) - 1)
            x = np.append(count * (SCALE / max(words, 1)), 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def _counted(batches) -> Iterator:
    import numpy as np
    import pyarrow as pa

    shapes = Shapes()
    for batch in batches:
        columns = ([], [], [], [], [])
        for doc_id, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, n = indexes(text, shapes)
            index, count = np.unique(found, return_counts=True)
            for c, x in zip(columns, (doc_id, label, index.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), n), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "label", "index", "count", "words"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE):
    """Weights from the labelled rows that are not held out; None without any."""
    import numpy as np

    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (residue(F.col("doc_id"), MODULUS) != HELD_OUT)).select("doc_id", F.col(label).cast("int").alias("__label")).distinct()
    hashed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = hashed.select("doc_id", "hash")  # what is joined with the labels, of which there may be any number, goes without texts
    count = keys.join(known, "doc_id").agg(F.approx_count_distinct(F.struct("doc_id", "__label", "hash"), 0.02)).first()[0]
    if not count:
        return None
    lucky = F.xxhash64("doc_id", "hash", F.lit("quality")).cast("double") / F.lit(2.0**64) + 0.5 < min(1.0, sample / count)
    chosen = keys.where(lucky).join(known, "doc_id").distinct()
    drawn = hashed.where(lucky).join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "__label", "hash"])
    got = drawn.select("doc_id", "text", "__label").mapInArrow(_counted, "doc_id long, label int, index binary, count binary, words long").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
    return ftrl([(r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32), r[4]) for r in got]) if got else None


def score_rows(docs: DataFrame, weights) -> DataFrame:
    """doc_id and score of every row."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(np.zeros((1 << BITS) + 1, np.float32) if weights is None else weights)

    def run(batches) -> Iterator:
        import pyarrow as pa

        w, shapes = shared.value, Shapes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found, n = indexes(text, shapes)
                out.append(float(w[found].sum(dtype=np.float64)) * SCALE / max(n, 1) + float(w[-1]))
            score = 1 / (1 + np.exp(-np.clip(np.array(out), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_rows(docs, train(docs, labels))
    held = F.coalesce(residue(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
