"""Language-model scoring: a log-bilinear model over word classes, trained in numpy with noise-contrastive estimation.

Counts. One pass over the training rows counts every word; the counts are a table as large as the vocabulary. The HOT
most frequent words (a fixed number) are broadcast with their counts; other words of a text meet their counts in a join,
so counts are exact for every word at any size, and the words that would make the join uneven never enter it.

Model. The most frequent words are classes of their own; all others share classes by their last two bytes, and the end
is a class. The log-bilinear model predicts the class from the two classes before:
    s(w | u, v) = (C1[u] + C2[v]) . Q[w] + b[w],    P = exp(s) / sum over classes.
As s is a sum of a table for u, one for v and the biases, two products of matrices give all scores, and batched products
give the normaliser of every pair of classes; scoring a token is four look-ups. A word of a shared class then has the
chance (c+1) / (N_class + V_class + 1) in its class, so that log-probabilities are normalised over all known words and
one unknown word a class.

Training. A pilot on the driver gives the start, from about PILOT tokens, an eighth of those of texts drawn by hash (a bounded
sample, however long a text is); then every task runs noise-contrastive updates over all training tokens of its split, and
the parameters are averaged in a tree of FAN at a time, weighted by tokens. All training rows take part at every size. As in
any parameter averaging, the result depends on how the files are split, but not on when tasks run or rerun.

Defined results: a null or empty text is only its end; rows with a null id are scored and never learnt from; repeated
rows are learnt as often as they occur and each get the same result; without training rows both scores are 0 for every
text; texts of any length are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, residue, table

#: Fixed values of the contract: rows with this remainder are held out.
MODULUS, HELD_OUT = 7, 2
#: Classes: WORDS frequent words, SHARED groups of the others, the end. Vectors of DIM. Words whose counts are broadcast.
WORDS, SHARED, DIM, HOT = 960, 63, 24, 1 << 19
CLASSES = WORDS + SHARED + 1
END = CLASSES - 1
#: Tokens of the pilot, and how often it reads them; noise samples; tokens and distinct trigrams that are learnt at a time;
#: step size; parameters that are averaged by one task.
PILOT, PILOT_EPOCHS, NOISE, CHUNK, BATCH, RATE, FAN = 1_000_000, 3, 64, 1_000_000, 4_096, 0.15, 64
FLUSH = 400_000


def shared_class(word: bytes) -> int:
    """0 to SHARED-1 from the word's last two bytes."""
    return xxhash.xxh32_intdigest(word[-2:]) % SHARED


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count(batches) -> Iterator:
    """Partial counts of words by hash; the end's word is empty, so it has the hash of no bytes."""
    import pyarrow as pa

    counts: Counter = Counter()

    def flush():
        keys = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in counts]
        columns = [pa.array(keys, pa.int64()), pa.array([shared_class(w) for w in counts], pa.int32()), pa.array(counts.values(), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "shared", "c"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_words(text))
            counts[b""] += 1
            if len(counts) >= FLUSH:
                yield flush()
    if counts:
        yield flush()


class Vocabulary:
    """Counts of the hot words, most frequent first, the class totals, and for each hot word its class and log terms."""

    def __init__(self, hashes, shared, counts, ends: int, n: int, v: int, group_n, group_v):
        import numpy as np

        order = np.lexsort((hashes, -counts))
        hashes, counts, shared = hashes[order], counts[order], shared[order]
        head = np.arange(len(order)) < WORDS
        #: tokens and words of the shared classes: those of all words less the head's
        self.group_n = group_n - np.bincount(shared[head], counts[head], SHARED)
        self.group_v = group_v - np.bincount(shared[head], minlength=SHARED)
        self.n, self.v, self.ends = n, v, ends
        self.classes = np.where(head, np.arange(len(order)), WORDS + shared).astype(np.int32)
        self.base = np.log10(counts + 1.0)
        self.within = np.where(head, 0.0, self.base - self.group_log()[shared])
        self.noise = np.zeros(CLASSES)
        self.noise[: head.sum()], self.noise[WORDS:END], self.noise[END] = counts[head], np.maximum(self.group_n, 0), ends
        self.noise = (self.noise + 1) / (self.noise + 1).sum()
        self.hashes = hashes

    def places(self) -> dict[int, int]:
        """Place of each hot word by its hash; made once in each Python worker."""
        if "_places" not in self.__dict__:
            self._places = dict(zip(self.hashes.tolist(), range(len(self.hashes)), strict=True))
        return self._places

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k != "_places"}

    def group_log(self):
        import numpy as np

        return np.log10(np.maximum(self.group_n + self.group_v + 1.0, 1.0))


class Index(dict):
    """word -> place among the hot words, or -1 - shared class."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.places = vocabulary, vocabulary.places()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= FLUSH:
            self.clear()
        place = self.places.get(xxhash.xxh64_intdigest(word) - (1 << 63))
        self[word] = value = place if place is not None else -1 - shared_class(word)
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _classes(at, vocabulary: Vocabulary):
    """Classes of places, with the end after them."""
    import numpy as np

    out = np.full(len(at) + 1, END, np.int64)
    hot = at >= 0
    out[:-1][hot] = vocabulary.classes[at[hot]]
    out[:-1][~hot] = WORDS - 1 - at[~hot]
    return out


def _row_sums(index, rows):
    """Sums of the rows of each class, by one sort."""
    import numpy as np

    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    out = np.zeros((CLASSES, rows.shape[1]), rows.dtype)
    out[sorted_[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Model:
    """Parameters C1, C2, Q, b with their sums of squared gradients; learns from trigrams of classes."""

    def __init__(self, noise, parameters=None, seed: int = 1):
        import numpy as np

        self.rng = np.random.default_rng(seed)
        shape = (CLASSES, DIM)
        start = parameters or [self.rng.normal(0, 0.1, shape), self.rng.normal(0, 0.1, shape), self.rng.normal(0, 0.1, shape), np.log(noise)]
        self.parameters = [np.array(p, np.float32) for p in start]
        self.squares, self.noise, self.weight = [np.full_like(p, 0.1) for p in self.parameters], noise, 0

    def learn(self, codes, counts=None) -> None:
        """codes: (u * CLASSES + v) * CLASSES + w of each token, or of different ones with their counts."""
        import numpy as np

        if counts is None:
            codes, counts = np.unique(codes, return_counts=True)
        order = self.rng.permutation(len(codes))
        for part in np.array_split(order, 1 + len(order) // BATCH):
            if len(part):
                self._step(codes[part], counts[part].astype(np.float32))
        self.weight += int(counts.sum())

    def _step(self, codes, counts) -> None:
        import numpy as np

        c1, c2, q, b = self.parameters
        w, v, u = codes % CLASSES, codes // CLASSES % CLASSES, codes // CLASSES**2
        noise = self.rng.choice(CLASSES, NOISE, p=self.noise)
        shift = np.log(NOISE * self.noise).astype(np.float32)
        r = c1[u] + c2[v]
        # d log-likelihood / d score: 1 - sigmoid for the word seen, -sigmoid for each noise word
        seen = counts / (1 + np.exp(np.clip((r * q[w]).sum(1) + b[w] - shift[w], -30, 30)))
        false = -counts[:, None] / (1 + np.exp(-np.clip(r @ q[noise].T + b[noise] - shift[noise], -30, 30)))
        total = counts.sum()
        gr = (seen[:, None] * q[w] + false @ q[noise]) / total
        gq = (_row_sums(w, seen[:, None] * r) + _row_sums(noise, false.T @ r)) / total
        gb = ((np.bincount(w, seen, CLASSES) + np.bincount(noise, false.sum(0), CLASSES)) / total).astype(np.float32)
        g1, g2 = _row_sums(u, gr), _row_sums(v, gr)
        for p, s, g in zip(self.parameters, self.squares, (g1, g2, gq, gb), strict=True):
            g = g * 100
            s += g * g
            p += RATE * g / np.sqrt(s)


def trigrams(classes):
    """Codes of a text's classes with the two before each; a text begins after two ends."""
    import numpy as np

    padded = np.concatenate([[END, END], classes])
    return (padded[:-2] * CLASSES + padded[1:-1]) * CLASSES + padded[2:]


def _learn(texts: Iterator, model: Model, index: Index) -> None:
    import numpy as np

    held, size = [], 0
    for text in texts:
        held.append(trigrams(_classes(index.of(_words(text)), index.v)))
        size += len(held[-1])
        if size >= CHUNK:
            model.learn(np.concatenate(held))
            held, size = [], 0
    if held:
        model.learn(np.concatenate(held))


def tables(parameters):
    """(by u, by v with the biases, log-normaliser of u and v), all in natural logarithms, by products of matrices."""
    import numpy as np

    c1, c2, q, b = (p.astype(np.float32) for p in parameters)
    by_u, by_v = c1 @ q.T, c2 @ q.T + b
    top_u, top_v = by_u.max(1), by_v.max(1)
    sums = np.exp(by_u - top_u[:, None]) @ np.exp(by_v - top_v[:, None]).T
    return by_u, by_v, np.log(np.maximum(sums, 1e-30)) + top_u[:, None] + top_v[None]


def gather(rows: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """The table of all counts (word, shared, c) of rows (text), and the vocabulary."""
    import numpy as np

    counts = rows.select("text").mapInArrow(_count, "word long, shared int, c long").groupBy("word", "shared").agg(F.sum("c").alias("c"))
    counts = materialize(counts)
    end = xxhash.xxh64_intdigest(b"") - (1 << 63)
    words = counts.where(F.col("word") != end)
    groups = words.groupBy("shared").agg(F.sum("c"), F.count("*")).collect()
    group_n, group_v = np.zeros(SHARED), np.zeros(SHARED)
    for k, n, v in groups:
        group_n[k], group_v[k] = n, v
    ends = (counts.where(F.col("word") == end).agg(F.sum("c")).first()[0]) or 0
    # how many words have each count, rounded down to 1/16 of its power of two: a bounded number of steps to choose from
    step = F.pow(F.lit(2.0), F.floor(F.log2("c")) - 4)
    level = F.greatest(F.lit(1.0), F.floor(F.col("c") / step) * step).alias("level")
    floor_, held = float("inf"), 0
    for x, k in sorted(map(tuple, words.groupBy(level).count().collect()), reverse=True):
        if held + k > HOT:
            break
        floor_, held = x, held + k
    hot = words.where(F.col("c") >= floor_).toArrow() if held else None
    column = lambda name, kind: np.array(hot.column(name), kind) if hot is not None else np.empty(0, kind)
    n, v = int(group_n.sum()) + ends, int(group_v.sum()) + (ends > 0)
    return counts, Vocabulary(column("word", np.int64), column("shared", np.int64), column("c", np.int64), ends, n, v, group_n, group_v)


def train(rows: DataFrame, vocabulary) -> list:
    """Parameters from all rows (doc_id, text); vocabulary is a broadcast of a Vocabulary."""
    import numpy as np

    v = vocabulary.value
    rate = min(1.0, PILOT / max(1, v.n))
    share = min(1.0, 8 * rate)  # of the texts; of their tokens then rate / share

    def draw(batches) -> Iterator:
        import pyarrow as pa

        index = Index(vocabulary.value)
        for b in batches:
            found = [np.empty(0, np.int64)]
            for text in b.column(0).to_pylist():
                codes = trigrams(_classes(index.of(_words(text)), index.v))
                found.append(codes[np.random.default_rng(xxhash.xxh32_intdigest(text or b"")).random(len(codes)) < rate / share])
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])

    u = F.xxhash64("text", F.lit("pilot")).cast("double") / F.lit(2.0**64) + 0.5
    drawn = rows.where(u < share).select("text").mapInArrow(draw, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(drawn.column("code").to_numpy())
    codes, counts = (drawn.column(c).to_numpy()[order] for c in ("code", "n"))
    pilot = Model(v.noise)
    for _ in range(PILOT_EPOCHS):
        if len(codes):
            pilot.learn(codes, counts)
    start = rows.sparkSession.sparkContext.broadcast(pilot.parameters)

    def run(batches) -> Iterator:
        import pyarrow as pa

        model = Model(vocabulary.value.noise, start.value)
        _learn((t for b in batches for t in b.column(0).to_pylist()), model, Index(vocabulary.value))
        if model.weight:
            flat = np.concatenate([p.ravel() for p in model.parameters]).astype(float) * model.weight
            yield pa.RecordBatch.from_arrays([pa.array([model.weight], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["weight", "flat"])

    def add(batches) -> Iterator:
        import pyarrow as pa

        total, weight = 0.0, 0
        for b in batches:
            for w, flat in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total, weight = total + np.frombuffer(flat), weight + w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["weight", "flat"])

    kind = "weight long, flat binary"
    each = materialize(rows.select("text").mapInArrow(run, kind))
    while (n := each.count()) > FAN:
        each = materialize(each.repartition(-(-n // FAN)).mapInArrow(add, kind))
    sums = sorted(map(tuple, each.collect()))
    if not sums:
        return pilot.parameters
    flat = sum(np.frombuffer(r[1]) for r in sums) / sum(r[0] for r in sums)
    k = CLASSES * DIM
    return [*(flat[i * k : (i + 1) * k].reshape(CLASSES, DIM) for i in range(3)), flat[3 * k :]]


PART = "doc long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word long, times long"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(residue(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)))
    training = rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    counts, v = gather(training)
    vocabulary = spark.broadcast(v)
    shared = spark.broadcast(tables(train(training, vocabulary)) if v.n else None)

    def run(batches) -> Iterator:
        """For each text one row of what the hot words give, and one for each other word that it has."""
        import math

        import numpy as np
        import pyarrow as pa

        v, index = vocabulary.value, Index(vocabulary.value)
        group_log, ln10 = v.group_log(), math.log(10)
        denominator = math.log10(v.n + v.v + 1)
        by_u, by_v, norm = shared.value or (None, None, None)
        names = [c.split()[0] for c in PART.split(", ")]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words(text)
                at = index.of(words)
                hot = at >= 0
                classes = _classes(at, v)
                base = v.base[at[hot]].sum() + math.log10(v.ends + 1) - denominator * len(classes)
                total = 0.0
                if by_u is not None:
                    p = np.concatenate([[END, END], classes])
                    total = float((by_u[p[:-2], p[2:]] + by_v[p[1:-1], p[2:]] - norm[p[:-2], p[1:-1]]).sum(dtype=np.float64)) / ln10
                    total += v.within[at[hot]].sum() - group_log[-1 - at[~hot]].sum()
                doc = xxhash.xxh64_intdigest(b"%d " % doc_id + (text or b"") if doc_id is not None else b"none " + (text or b"")) - (1 << 63)
                row = (doc, doc_id, held, len(classes), int(hot.sum()) + (v.ends > 0), float(base), float(total), doc, 0)
                rare = Counter(words[i] for i in np.flatnonzero(~hot))
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
                if rare:
                    k = len(rare)
                    keys = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in rare]
                    for c, x in zip(columns, ([doc] * k, [None] * k, [None] * k, [0] * k, [0] * k, [0.0] * k, [0.0] * k, keys, rare.values()), strict=True):
                        c.extend(x)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    parts = rows.select("doc_id", "held_out", "text").mapInArrow(run, PART)
    met = parts.join(counts.select(F.col("word"), F.col("c")), "word", "left")
    more = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)
    known = F.when((F.col("times") > 0) & F.col("c").isNotNull(), F.col("times")).otherwise(0)
    text_row = F.col("times") == 0
    each = met.groupBy("doc").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.count(F.when(text_row, 1)).alias("copies"),
        F.max(F.when(text_row, F.struct("base", "score", "known"))).alias("hot"),
        F.sum(more).alias("more"),
        F.sum(known).alias("rare_known"),
    )
    copies = F.col("copies")
    result = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    lit = lambda x: F.lit(int(x)).cast("long")
    return result.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot.known") + (F.col("rare_known") / copies).cast("long")).alias("n_known"),
        lit(v.n).alias("train_tokens"),
        (F.col("hot.base") + F.col("more") / copies).alias("base_score"),
        (F.col("hot.score") + (F.col("more") / copies if v.n else F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
