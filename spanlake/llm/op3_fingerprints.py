"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a text's cells are the 64-bit digests of its paragraphs and of the pieces of each paragraph (12 bytes
and the rest of the word, 48 bytes at most, cut at a character's start), so that a change inside a long paragraph is told
from a new paragraph. A digest's lowest bit says whether it is a paragraph's. Each distinct digest is put into one cell of
each of three tables, as count, sum of digests and sum of check values. Two versions' sketches are subtracted cell by cell;
what they share cancels out, and peeling cells that hold a single digest recovers the digests by which they differ
(`differences`). If peeling sticks, both are sketched with GROWTH times the cells and tried again. The likeness is the
Jaccard similarity that follows from the recovered differences and the two numbers of digests.

The fingerprint is the base64 text of the smallest sketch with the number of digests and a digest of the whole text, so
it is a function of the text alone and of bounded length.

A document's next document stands after it by (id, hash of the text, hash of the row's place in its files), null ids first.
Sampled splitters of that key, weighted by length, cut the rows into ranges, so that neither rows with one id nor rows that
are equal in all columns make a range too large; each range is one task, and the first document of a range is dealt to the
range before it as well, so neighbours meet. The driver holds the sampled keys and one key for each range.

Defined results: a null text is an empty one; two texts without pieces have likeness 1, one of them 0; a single document
is its own next; repeated rows follow one another; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, place_of, quantile_keys, sampled_keys, table, with_row_key

#: Tables of a sketch, cells of a table of the fingerprint (powers of two), how the cells grow when peeling fails.
TABLES, CELLS, GROWTH = 3, 4, 16
#: Documents and bytes of text that are worked on together; cells that are held together.
ROWS, BYTES, HELD = 256, 1 << 22, 1 << 20
LEAST_ID = -(2**63)
#: Samples a range, bytes of text a range.
SAMPLES, RANGE_BYTES = 32, 64 << 20
KEY = ["__i", "__h", "__t"]
#: A piece: 12 bytes, to the end of the word (36 bytes more, and to a character's end) and the space after it.
_PIECE = re.compile(rb"[^\n]{1,12}[^\s]{0,36}+[\x80-\xBF]{0,3}+[^\S\n]*+")
PARAGRAPH = 1


def cells_of(text: bytes) -> dict[int, bytes]:
    """The text's digests with the paragraph or piece that each stands for."""
    import xxhash

    of = xxhash.xxh64_intdigest
    lines = [line for line in text.split(b"\n") if line.strip()]
    return {of(p) & ~PARAGRAPH: p for line in lines for p in _PIECE.findall(line)} | {of(line, 1) | PARAGRAPH: line for line in lines}


def digests(text: bytes):
    """Sorted distinct 64-bit digests of the paragraphs and pieces."""
    import numpy as np
    import xxhash

    lines = [line for line in text.split(b"\n") if line.strip()]
    pieces = _PIECE.findall(b"\n".join(lines))
    small = np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces)) & ~np.uint64(PARAGRAPH)
    large = np.fromiter((xxhash.xxh64_intdigest(line, 1) for line in lines), np.uint64, len(lines)) | np.uint64(PARAGRAPH)
    return np.unique(np.concatenate([small, large]))


def _mix(x, seed: int):
    import numpy as np

    x = (x ^ (x >> np.uint64(30)) ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(keys, cells: int, seed: int):
    """For each table the cells of the keys; the tables stand one after another."""
    import numpy as np

    return [(_mix(keys, seed * 8 + j + 1) & np.uint64(cells - 1)).astype(np.int64) + j * cells for j in range(TABLES)]


def sketch(sets: list, cells: int, seed: int = 0):
    """(count, sum, check) of shape (sets, TABLES * cells) for a list of digest sets."""
    import numpy as np

    width = TABLES * cells
    count, total, check = (np.zeros(len(sets) * width, kind) for kind in (np.int64, np.uint64, np.uint64))
    keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    base, marks = np.repeat(np.arange(len(sets)) * width, [len(s) for s in sets]), _mix(keys, 99)
    for at in _cells(keys, cells, seed):
        np.add.at(count, base + at, 1)
        np.add.at(total, base + at, keys)
        np.add.at(check, base + at, marks)
    return tuple(x.reshape(len(sets), width) for x in (count, total, check))


def peel(count, total, check, cells: int, seed: int = 0):
    """From subtracted sketches: (row, digest, 1 or -1 for the side that has it) of what is recovered, and by row whether
    that is all. The arrays are used up."""
    import numpy as np

    rows, width = count.shape
    count, total, check = count.reshape(-1), total.reshape(-1), check.reshape(-1)
    at, found = np.arange(len(count)), [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
    while True:
        at = at[np.abs(count[at]) == 1]
        sign = count[at].view(np.uint64)  # 1, or -1 modulo 2**64
        keys = total[at] * sign
        pure = check[at] * sign == _mix(keys, 99)
        if not pure.any():
            break
        row, keys, sign = at[pure] // width, keys[pure], count[at][pure]
        _, first = np.unique(_mix(keys, 7) ^ _mix(row.astype(np.uint64), 11), return_index=True)
        row, keys, sign = row[first], keys[first], sign[first]
        found.append((row, keys, sign))
        marks, unsigned, touched = _mix(keys, 99), sign.view(np.uint64), []
        for cell in _cells(keys, cells, seed):
            cell = cell + row * width
            np.subtract.at(count, cell, sign)
            np.subtract.at(total, cell, keys * unsigned)
            np.subtract.at(check, cell, marks * unsigned)
            touched.append(cell)
        at = np.unique(np.concatenate(touched))
    whole = ~((count != 0) | (total != 0)).reshape(rows, width).any(1)
    return *(np.concatenate(x) for x in zip(*found, strict=True)), whole


def recovered(lefts: list, rights: list) -> Iterator[tuple]:
    """(numbers of the pairs, row among them, digest, sign) of all differences of pairs of digest sets, in parts: subtract and
    peel, larger again where that fails."""
    import numpy as np

    size = np.array([len(a) + len(b) for a, b in zip(lefts, rights, strict=True)], np.int64)
    todo, cells, seed = np.arange(len(lefts)), CELLS, 0
    while len(todo):
        failed = []
        for part in np.array_split(todo, 1 + len(todo) * TABLES * cells // HELD):
            if not len(part):
                continue
            a, b = sketch([lefts[i] for i in part], cells, seed), sketch([rights[i] for i in part], cells, seed)
            row, keys, sign, whole = peel(*(x - y for x, y in zip(a, b, strict=True)), cells, seed)
            good = whole[row]
            yield part, row[good], keys[good], sign[good]
            failed.append(part[~whole])
        todo = np.concatenate(failed)
        if len(todo) and cells > 4 * size[todo].max():
            seed += 1  # large enough and still stuck: other cells for the same digests
        else:
            cells *= GROWTH


def likeness(lefts: list, rights: list):
    """(Jaccard similarity, paragraphs only on the left) of each pair of digest sets, from the recovered differences."""
    import numpy as np

    na, nb = (np.array([len(s) for s in x], np.int64) for x in (lefts, rights))
    only_a, paragraphs = np.zeros(len(na), np.int64), np.zeros(len(na), np.int64)
    for part, row, keys, sign in recovered(lefts, rights):
        only_a += np.bincount(part[row[sign > 0]], minlength=len(na))
        paragraphs += np.bincount(part[row[(sign > 0) & (keys & np.uint64(PARAGRAPH) > 0)]], minlength=len(na))
    both = na - only_a
    return np.where(na + nb == 0, 1.0, both / np.maximum(na + nb - both, 1)), paragraphs


def differences(left: bytes, right: bytes) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """The digests that peeling recovers, with their paragraphs or pieces: those of the left text only, of the right only."""
    a, b = cells_of(left), cells_of(right)
    out: tuple[dict, dict] = ({}, {})
    for _, _, keys, sign in recovered([digests(left)], [digests(right)]):
        for k, s in zip(keys.tolist(), sign.tolist(), strict=True):
            out[s < 0][k] = (a if s > 0 else b)[k]
    return out


def fingerprints(texts: list[bytes], sets: list) -> list[str]:
    import numpy as np
    import xxhash

    count, total, check = sketch(sets, CELLS)
    out = []
    for text, s, a, b, c in zip(texts, sets, count.astype("<u2"), total.astype("<u8"), (check >> np.uint64(32)).astype("<u4"), strict=True):
        out.append(base64.b64encode(xxhash.xxh64_digest(text) + len(s).to_bytes(4, "little") + a.tobytes() + b.tobytes() + c.tobytes()).decode())
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _pairs(batches) -> Iterator[list[tuple[int, str, str]]]:
    """Chunks of (id, text, next text) from rows sorted by (range, tail, id, text); tails are only next texts."""
    held, chunk, size = None, [], 0
    for batch in batches:
        for part, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if held and held[0] == part:
                chunk.append((held[1], held[2], text))
                size += len(held[2])
            held = None if tail else (part, doc_id, text)
            if len(chunk) >= ROWS or size >= BYTES:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, pieces long, paragraphs_lost long"


def _fingerprint_rows(batches) -> Iterator:
    import pyarrow as pa

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for chunk in _pairs(batches):
        ids, texts, following = zip(*chunk, strict=True)
        own, new, nxt = ([x.encode("utf-8", "surrogatepass") for x in c] for c in (texts, map(edited, texts, following), following))
        known: dict[bytes, object] = {}
        of = lambda t, known=known: known[t] if t in known else known.setdefault(t, digests(t))
        a, b, c = ([of(t) for t in x] for x in (own, new, nxt))
        near, lost = likeness(a, b)
        columns = [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in new])]
        columns += [pa.array(fingerprints(own, a)), pa.array(fingerprints(new, b)), pa.array(near), pa.array(likeness(a, c)[0]), pa.array(map(len, a), pa.int64()), pa.array(lost)]
        yield pa.RecordBatch.from_arrays(columns, names)


def fingerprint(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, pieces (digests of the text) and
    paragraphs_lost (paragraphs that the edited text lacks) of every row."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select("doc_id", "text"), "__t").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__t")
    rows = rows.withColumns({"__i": F.coalesce("doc_id", F.lit(LEAST_ID)), "__h": F.xxhash64(F.coalesce("text", F.lit("")))})
    keys = materialize(rows.select(*KEY, (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("__s")))
    total = keys.agg(F.sum("__s")).first()[0]
    if not total:
        return spark.createDataFrame([], SCHEMA)
    parts = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    splitters = quantile_keys(*sampled_keys(keys, KEY, "__s", parts * SAMPLES / total, 1), parts)
    part_of = place_of(spark, splitters)
    firsts = sorted((r["part"], *r["first"]) for r in keys.groupBy(part_of(*KEY).alias("part")).agg(F.min(F.struct(*KEY)).alias("first")).collect())
    # the first row of each range also goes to the range before it, that of the first range to the last
    before = spark.createDataFrame([(*f[1:], firsts[n - 1][0]) for n, f in enumerate(firsts)], "__i long, __h long, __t long, before long")
    heads = rows.join(F.broadcast(before), KEY).select(F.col("before").alias("part"), F.lit(True).alias("tail"), "doc_id", "text", *KEY)
    dealt = rows.select(part_of(*KEY).alias("part"), F.lit(False).alias("tail"), "doc_id", "text", *KEY).unionByName(heads)
    dealt = dealt.repartitionById(len(splitters) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "tail", *KEY)
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(_fingerprint_rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
