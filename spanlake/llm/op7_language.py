"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier a bit (logistic regression on hashed byte trigrams) predicts the
text's bits, and the language whose codeword has the least total logistic loss against the predicted margins wins.
exp(-loss) in relation to all languages' is the score; a text is ambiguous if the second-best codeword is as near as the
best up to `AMBIGUOUS` in score. The mean loss a bit to the nearest codeword is the distance; a text whose distance is above
`FAR` (guessing has 0.69) is near no codeword at all.

The classifiers learn from at most about `sample` labelled texts a language and `TEXTS` in all, drawn by a hash of the id (a
bounded fit; counts of labelled rows cover all data). Their features are made on the executors, so the driver gets at most
one number a trigram bucket of a text, however long it is; every text is scored whole. The model is one matrix of fixed size.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if there was nothing to
learn from; rows with a null id are scored and are never learnt from; repeated rows get the same result; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import bounded_batches, giving_back, residue, table

#: Fixed values of the contract: rows with this remainder are held out.
MODULUS, HELD_OUT, UND = 4, 2, "und"
BUCKETS, SAMPLE, TEXTS, EPOCHS, RATE, AMBIGUOUS, FAR = 1 << 13, 600, 24_000, 30, 0.05, 0.6, 0.6
#: Documents that are scored at a time, and bytes of text.
ROWS, BYTES = 256, 1 << 22


def _plain() -> bytes:
    """Letters in lower case and bytes above ASCII stand for themselves, everything else for a space."""
    return bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features(texts: list[bytes]):
    """For each text the shares of hashed byte trigrams, as float32 rows; white space is one space."""
    import numpy as np

    x, plain = np.zeros((len(texts), BUCKETS), np.float32), _plain()
    for row, text in zip(x, texts, strict=True):
        b = np.frombuffer(b" " + b" ".join(text.translate(plain).split()) + b" ", np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(19)
            row[:] = np.bincount(h, minlength=BUCKETS)
            row *= 100 / len(h)
    return np.sqrt(x)


def codewords(languages: int):
    """A row of +1/-1 for each language. Up to 5 languages take every split once; more take the farthest of random codes."""
    import numpy as np

    if languages <= 5:
        splits = range(1, 2 ** max(1, languages - 1))
        return np.array([[1 if k == 0 or not s >> (k - 1) & 1 else -1 for s in splits] for k in range(languages)], np.float32)
    rng, bits, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(languages))), (-1, None)
    for _ in range(200 if languages <= 200 else 20):
        code = rng.choice(np.array([-1, 1], np.float32), (languages, bits))
        common = code @ code.T
        np.fill_diagonal(common, -bits)
        best = max(best, (int((bits - common.max()) / 2), code), key=lambda c: c[0])
    return best[1]


def _sparse(batches) -> Iterator:
    """Features of each text and of a short cut of it, so that short texts are met too."""
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out = ([], [], [], [])
        for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cut = text[len(text) // 3 :][: 40 + 17 * (zlib.crc32(b"%d" % doc_id) % 20)]
            for kind, row in enumerate(features([text, cut])):
                at = np.flatnonzero(row)
                for c, x in zip(out, (doc_id * 2 + kind, lang, at.astype(np.uint16).tobytes(), row[at].tobytes()), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.decimal128(38, 0), pa.string(), pa.binary(), pa.binary()), strict=True)], ["row", "lang", "at", "value"])


def fit(rows: list[tuple], langs: list[str]):
    """(languages, code, weights, bias): Adam on the mean logistic loss of all bits at once, from sparse features (buckets,
    values); only one step's rows are dense at a time."""
    import numpy as np

    names = sorted(set(langs))
    code = codewords(len(names))
    number = {g: k for k, g in enumerate(names)}
    y = code[np.array([number[g] for g in langs])]
    rng, w, b = np.random.default_rng(11), np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 200)):
            x = np.zeros((len(part), BUCKETS), np.float32)
            for i, r in enumerate(part):
                x[i, rows[r][0]] = rows[r][1]
            g = -y[part] / (1 + np.exp(np.clip(y[part] * (x @ w + b), -30, 30))) / len(part)
            gw, step = x.T @ g + 1e-5 * w, step + 1
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            w -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            b -= RATE * g.sum(0)
    return names, code, w, b


def decode(texts: list[bytes | None], model) -> tuple[list[str], list[float], list[bool], list[float | None]]:
    """Language, score, whether it is ambiguous, and distance, for each text; the distance is null without a letter, and 0 if
    there was nothing to learn from."""
    import numpy as np

    names, code, w, b = model
    has = [bool(t) and (any(65 <= c <= 90 or 97 <= c <= 122 for c in t[:200]) or any(map(str.isalpha, t.decode("utf-8", "replace")))) for t in texts]
    langs, scores, unsure, far = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts), [0.0 if h else None for h in has]
    full = [i for i, h in enumerate(has) if h and names]
    if full:
        margin = features([texts[i] for i in full]) @ w + b
        loss = np.logaddexp(0, -code[None] * margin[:, None]).sum(2)
        near = np.exp(loss.min(1, keepdims=True) - loss)
        best, score = loss.argmin(1), 1 / near.sum(1)
        for i, k, s, d in zip(full, best, score, loss.min(1) / code.shape[1], strict=True):
            langs[i], scores[i], unsure[i], far[i] = names[k], float(s), bool(s < AMBIGUOUS), float(d)
    return langs, scores, unsure, far


def train(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE):
    """A model from rows (row id doc_id) that are not held out and have a language."""
    import numpy as np

    rows = bounded_batches(docs).where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & (residue(F.col("doc_id"), MODULUS) != HELD_OUT) & F.col("text").isNotNull())
    counts = rows.groupBy(lang).count().collect()
    if not counts:
        return [], None, None, None
    u = F.xxhash64("doc_id", F.lit("language")).cast("double") / F.lit(2.0**64) + 0.5
    sample = max(1, min(sample, TEXTS // len(counts)))
    rates = F.create_map(*[F.lit(x) for k, n in counts for x in (k, min(1.0, sample / n))])
    drawn = rows.where(u < rates[F.col(lang)]).select(F.col("doc_id").cast("long"), F.col(lang).cast("string"), F.col("text").cast("binary"))
    got = sorted(map(tuple, drawn.mapInArrow(giving_back(_sparse), "row decimal(38,0), lang string, at binary, value binary").collect()))
    return fit([(np.frombuffer(r[2], np.uint16), np.frombuffer(r[3], np.float32)) for r in got], [r[1] for r in got]) if got else ([], None, None, None)


def predict(docs: DataFrame, model, *keep: str) -> DataFrame:
    """lang_pred, score, ambiguous, distance of every row of docs, after the columns named in keep (as k0, k1, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = bounded_batches(docs).select(F.col("text").cast("binary").alias("__text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and end - at < ROWS and (end == at or held < BYTES):
                    held += len(texts[end] or b"")
                    end += 1
                langs, scores, unsure, far = decode(texts[at:end], shared.value)
                kept = [c.slice(at, end - at) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_()), pa.array(far, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score", "ambiguous", "distance"])
                at = end

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(giving_back(run), f"{schema}lang_pred string, score double, ambiguous boolean, distance double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without texts that have no letter or are far from every codeword; all columns stay, whatever their names. A text
    between two languages is near the codewords' common bits and stays; if there was nothing to learn from, all texts with
    letters do."""
    names = docs.columns
    found = predict(docs, train(docs), *names).where(F.col("distance") <= FAR)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def identify(docs: DataFrame) -> DataFrame:
    found = predict(docs, train(docs), "doc_id").withColumnRenamed("k0", "doc_id")
    return found.select("doc_id", F.coalesce(residue(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
