"""Benchmark decontamination by template canonicalisation.

Words are stripped of marks and lowered; numbers, units after a number, and names (capitalised words inside a sentence)
become typed placeholders. Windows of five template words with three plain ones at least are hashed, on both sides, and
joined by hash. A document holds an item

* if the item's windows that it has along one stretch of neighbouring diagonals (document position - item position, so that
  a word may be put in or left out) are half of the item's windows or more, and the slots that they cover are consistent
  both ways: a number, unit or name of the item stands for one value of the document, and a value of the document for one
  of the item. So re-parameterised questions are found, and chance matches of templates are not;
* or, however long the item is, if it repeats thirteen of its words in a row word for word, slots included, eight of them
  plain: an excerpt. The words must be covered by windows;
* or, for an item without such a window (under five words, or hardly a plain word), if it has all the item's words in a row,
  word for word.

The join is a Spark join of two tables of windows. A bitmap of the benchmark's window hashes, of bounded size, keeps most
windows of a document from entering it; the bits decide about cost only. A window that many items have is not met by each
document with each item: first only an item's anchors are joined, the windows that fewest items have, chosen so that a
document which holds the item has one of them; then the other windows of the pairs found. A group is one pair and one
stretch of diagonals, so it has at most a few times the item's windows, and the text's length does not matter.

Defined results: null or empty texts and items match nothing; repeated items and repeated document rows each give their
rows; ids may be null and are carried through; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.common import bounded_batches, broadcast_under, giving_back, materialize, table

WINDOW, PLAIN, SHARE, CONSISTENT = 5, 3, 0.5, 0.8
#: An excerpt: words in a row, and plain ones among them.
RUN, RUN_PLAIN = 13, 8
#: Diagonals of one stretch; bits of the bitmap for each window, and the most bits (as powers of two).
STRETCH, BITS_A_WINDOW, MOST_BITS = 8, 1024, 29
#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 200_000
#: Units of measure, money and time that may follow a number.
UNITS = frozenset(
    b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    b"mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    b"s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent "
    b"dollar dollars euro euros cent cents usd eur gbp kmh mph degree degrees".split()
)
NUMBER, UNIT, NAME = 0x1F3D5B79A1C2E480, 0x2B4D6F8193A5C7E0, 0x3C5A79B8D6F41230
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
CAPITAL, END, DIGIT, IS_UNIT = 1, 2, 4, 8


class Tokens(dict):
    """Raw word -> 60-bit hash of the plain word, and in the lowest four bits what decides about its type; 0: only marks."""

    most = 150_000

    def __missing__(self, raw: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        word = raw.strip(_MARKS.replace(b"%", b""))
        flags = (CAPITAL if word[:1].isupper() and not word[1:].isupper() else 0) | (END if raw.rstrip(b"\"')]}").endswith((b".", b"!", b"?", b":")) else 0)
        low = word.lower()
        if low[:1].isdigit() or (low[:1] in b"$-+" and low[1:2].isdigit()):
            flags |= DIGIT
        elif low in UNITS:
            flags |= IS_UNIT
        self[raw] = value = (xxhash.xxh64_intdigest(low) & ~15 | flags) if word else flags & END
        return value


def template(text: bytes | None, tokens: Tokens):
    """(hashes with placeholders, hashes of the words themselves): slots are where they differ."""
    import numpy as np

    raw = (text or b"").split()
    t = np.fromiter(map(tokens.__getitem__, raw), np.uint64, len(raw))
    flags, plain = t & np.uint64(15), t & ~np.uint64(15)
    word = plain != 0
    ends = (flags & np.uint64(END)) != 0
    start = np.ones(len(t), bool)
    start[1:] = ends[:-1]
    flags, plain, start = flags[word], plain[word], start[word]
    digit = (flags & np.uint64(DIGIT)) != 0
    unit = (flags & np.uint64(IS_UNIT)) != 0
    if len(unit):
        unit[1:] &= digit[:-1]
        unit[0] = False
    name = ((flags & np.uint64(CAPITAL)) != 0) & ~start
    return np.where(digit, np.uint64(NUMBER), np.where(unit, np.uint64(UNIT), np.where(name, np.uint64(NAME), plain))), plain


def _rolled(words, length: int, seed: int):
    """Hashes of every run of so many words."""
    import numpy as np

    n = max(0, len(words) - length + 1)
    h = np.full(n, seed, np.uint64)
    for j in range(length if n else 0):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def windows(canon, plain):
    """(hashes, how many plain words) of the windows of five template words."""
    import numpy as np

    h = _rolled(canon, WINDOW, 0)
    if not len(h):
        return h, h
    sums = np.concatenate([[0], np.cumsum(canon != plain)])
    return h, WINDOW - (sums[WINDOW:] - sums[:-WINDOW])


def details(canon, plain, at):
    """For the windows at these places: a word-for-word hash, the words in the first and second slot (0 for none; a window
    has two at most) and where in the window these are."""
    import numpy as np

    near = at[:, None] + np.arange(WINDOW)
    words = plain[near]
    exact = np.ones(len(at), np.uint64)
    for j in range(WINDOW):
        exact = (exact ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        exact ^= exact >> np.uint64(32)
    slot = canon[near] != words
    order = np.argsort(~slot, axis=1, kind="stable")[:, :2]
    values = np.take_along_axis(np.where(slot, words, np.uint64(0)), order, 1).view(np.int64)
    return exact.view(np.int64), values[:, 0], values[:, 1], order[:, 0], order[:, 1]


ITEM = "item long, item_id long, total long, whole boolean, run int, hash long, place long, exact long, s1 long, s2 long, p1 long, p2 long, rich long"


def _item_windows(batches) -> Iterator:
    """Windows of items; for an item without any, the runs of up to five of its words themselves (whole). rich: plain words
    among the thirteen from the window's first on, 0 if there are no thirteen."""
    import numpy as np
    import pyarrow as pa

    tokens = Tokens()
    names = [c.split()[0] for c in ITEM.split(", ")]
    for batch in batches:
        for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            canon, plain = template(text, tokens)
            h, n_plain = windows(canon, plain)
            at = np.flatnonzero(n_plain >= PLAIN)
            whole = not len(at)
            if whole:
                length = min(WINDOW, len(plain))
                h = _rolled(plain, length, 2 + length) if length else h
                at = np.arange(len(h))
                none = np.zeros(len(at), np.int64)
                exact, s1, s2, p1, p2, rich = h.view(np.int64), none, none, none, none, none
            else:
                exact, s1, s2, o1, o2 = details(canon, plain, at)
                p1, p2 = at + o1, at + o2
                sums = np.concatenate([[0], np.cumsum(canon == plain), np.full(RUN, -RUN * 2)])
                rich = np.maximum(0, sums[at + RUN] - sums[at]) if len(canon) >= RUN else np.zeros(len(at), np.int64)
            k = len(at)
            columns = [pa.array([x] * k, kind) for x, kind in ((item, pa.int64()), (item_id, pa.int64()), (k, pa.int64()), (whole, pa.bool_()), (length if whole else WINDOW, pa.int32()))]
            columns += [pa.array(np.asarray(x).view(np.int64)) for x in (h[at], at, exact, s1, s2, p1, p2, rich)]
            yield pa.RecordBatch.from_arrays(columns, names)


def least(total: int) -> int:
    """How many of so many windows a document must have."""
    return -int(-total * SHARE // 1)


def anchors_of(owners: list[int], places: list[int], whole: bool) -> list[bool]:
    """Which windows of an item to look up first: so many of the rarest that `least` windows must include one, and the rarest
    of the windows inside each thirteen words that begin with a window."""
    rank = sorted(range(len(places)), key=lambda i: (owners[i], places[i]))
    chosen = set(rank[: 1 if whole else len(places) - least(len(places)) + 1])
    if not whole:
        row = sorted(range(len(places)), key=lambda i: places[i])
        for n, i in enumerate(row):
            inside = [j for j in row[n : n + RUN - WINDOW + 1] if places[j] <= places[i] + RUN - WINDOW]
            chosen.add(min(inside, key=lambda j: (owners[j], places[j])))
    return [i in chosen for i in range(len(places))]


def index_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The benchmark's windows (ITEM) with `anchor`."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
    each = materialize(rows.mapInArrow(giving_back(_item_windows), ITEM))
    owners = each.groupBy("hash").agg(F.countDistinct("item").alias("owners"))

    def run(group):
        import pyarrow as pa

        anchor = anchors_of(*(group.column(c).to_pylist() for c in ("owners", "place")), group.column("whole")[0].as_py())
        return group.drop_columns(["owners"]).append_column("anchor", pa.array(anchor))

    return materialize(each.join(owners, "hash").select(*each.columns, "owners").groupBy("item").applyInArrow(run, ITEM + ", anchor boolean"))


class Bitmap:
    """Which hashes the benchmark has, by their highest bits, and the lengths of the runs that stand for short items."""

    def __init__(self, index: DataFrame):
        import numpy as np

        self.bits = min(MOST_BITS, max(16, (index.count() * BITS_A_WINDOW).bit_length()))
        place = F.shiftrightunsigned("hash", 64 - self.bits)
        rows = index.withColumn("bit", place).groupBy(F.shiftright("bit", 3).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 AS int))")).alias("b"))
        got = rows.toArrow()
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)
        self.table[got.column("byte").to_numpy()] = got.column("b").to_numpy().astype(np.uint8)
        self.lengths = sorted(r[0] for r in index.where("whole").select("run").distinct().collect())

    def may_have(self, h):
        import numpy as np

        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


FOUND = "row long, doc_id long, t1 long, t2 long, hash long, at long, exact long, s1 long, s2 long"


def text_key() -> list:
    """Two hashes that stand for a text; null for a null text."""
    text = F.col("text").cast("string")
    return [F.when(text.isNotNull(), F.xxhash64(text)).alias("t1"), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("t2")]


def _found(docs: DataFrame, bitmap: Bitmap) -> DataFrame:
    """Windows of the documents that the benchmark may have: FOUND, row being a number of the row."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.col("text").cast("binary").alias("text"))

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits, tokens = shared.value, Tokens()
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            parts, counts = [], []
            for text in batch.column(4).to_pylist():
                canon, plain = template(text, tokens)
                h, n_plain = windows(canon, plain)
                at = np.flatnonzero(bits.may_have(h))
                at = at[n_plain[at] >= PLAIN]
                n = len(at)
                if n:
                    parts.append((h[at].view(np.int64), at, *details(canon, plain, at)[:3]))
                for length in bits.lengths:
                    h = _rolled(plain, length, 2 + length)
                    at = np.flatnonzero(bits.may_have(h))
                    none = np.zeros(len(at), np.int64)
                    parts.append((h[at].view(np.int64), at, h[at].view(np.int64), none, none))
                    n += len(at)
                counts.append(n)
            if sum(counts):
                repeat = pa.array(np.repeat(np.arange(len(counts)), counts))
                columns = [c.take(repeat) for c in batch.columns[:4]] + [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(giving_back(run), FOUND)


def _matched(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, t1, t2) of rows with any window of the benchmark, and the windows that pairs with an anchor share."""
    found = materialize(_found(docs, Bitmap(index)))
    anchors = broadcast_under(index.where("anchor").select("hash", "item").distinct(), BROADCAST_ROWS)
    pairs = found.select("row", "hash").join(anchors, "hash").select("row", "item").distinct()
    sides = broadcast_under(index.withColumnsRenamed({"s1": "i1", "s2": "i2", "exact": "wanted"}), BROADCAST_ROWS)
    met = found.select("row", "hash", "at", "exact", "s1", "s2").join(pairs, "row").join(sides, ["item", "hash"])
    met = met.withColumns({"diagonal": F.col("at") - F.col("place"), "same": F.col("exact") == F.col("wanted")})
    return found.select("row", "doc_id", "t1", "t2").distinct(), materialize(met.drop("hash", "at", "exact", "wanted", "anchor", "run"))


def _by_share(met: DataFrame) -> DataFrame:
    """row, item, found, slots, same: pairs with half of the windows on one stretch of diagonals, slots consistent both ways."""
    band = F.explode(F.array(F.floor(F.col("diagonal") / STRETCH) * 2, F.floor((F.col("diagonal") + STRETCH // 2) / STRETCH) * 2 + 1))
    key = ["row", "item", "band"]
    banded = met.where("not whole").withColumn("band", band)
    many = banded.groupBy(*key, "total").agg(F.countDistinct("place").alias("found")).where(F.col("found") >= F.ceil(F.col("total") * SHARE)).drop("total")
    slot = F.explode(F.array(F.struct(F.col("p1").alias("p"), F.col("i1").alias("i"), F.col("s1").alias("s")), F.struct(F.col("p2").alias("p"), F.col("i2").alias("i"), F.col("s2").alias("s"))))
    slots = banded.join(many, key, "left_semi").select(*key, slot.alias("x")).where("x.i <> 0").select(*key, "x.*").distinct().groupBy(*key, "i", "s").agg(F.count("*").alias("n"))
    way = lambda side, name: slots.groupBy(*key, side).agg(F.max("n").alias("m"), F.sum("n").alias("n")).groupBy(*key).agg(F.sum("m").alias(name), F.sum("n").alias(f"{name}_of"))
    judged = many.join(way("i", "one"), key, "left").join(way("s", "other"), key, "left").na.fill(0)
    same = F.least("one", "other")
    good = judged.where(same >= CONSISTENT * F.col("one_of"))
    return good.groupBy("row", "item").agg(F.max(F.struct("found", F.col("one_of").alias("slots"), same.alias("same"))).alias("b")).select("row", "item", "b.*")


def _by_excerpt(met: DataFrame) -> DataFrame:
    """row, item: pairs with thirteen words in a row, word for word on one diagonal, or with all of an item that has no window."""
    line = Window.partitionBy("row", "item", "diagonal").orderBy("place")
    begins = F.coalesce(F.col("place") - F.lag("place").over(line) > WINDOW, F.lit(True)).cast("int")
    exact = met.where("same and not whole").select("row", "item", "diagonal", "place", "rich").distinct().withColumn("run", begins).withColumn("run", F.sum("run").over(line))
    last = F.max("place").over(Window.partitionBy("row", "item", "diagonal", "run"))
    excerpts = exact.withColumn("last", last).where((F.col("rich") >= RUN_PLAIN) & (F.col("last") + WINDOW >= F.col("place") + RUN)).select("row", "item")
    whole = met.where("whole").groupBy("row", "item", "diagonal", "total").agg(F.countDistinct("place").alias("found")).where("found = total").select("row", "item")
    return excerpts.unionByName(whole).distinct()


def _held(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """row, doc_id, t1, t2, item, item_id, windows_found, windows, slots, slots_consistent, excerpt: each pair once."""
    index = index_items(benchmark, item_id, text)
    rows, met = _matched(docs, index)
    pairs = _by_share(met).join(_by_excerpt(met).withColumn("excerpt", F.lit(True)), ["row", "item"], "outer")
    counts = met.groupBy("row", "item", "item_id", "total").agg(F.countDistinct("place").alias("windows_found"))
    out = counts.join(pairs, ["row", "item"]).join(rows, "row")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("row", "doc_id", "t1", "t2", "item", "item_id", "windows_found", F.col("total").alias("windows"), n("slots").alias("slots"), n("same").alias("slots_consistent"), F.coalesce("excerpt", F.lit(False)).alias("excerpt"))


def leaks(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, windows_found, windows, coverage, slots, slots_consistent, excerpt: a row for each item in each document."""
    return _held(docs, benchmark, item_id, text).select("doc_id", "item_id", "windows_found", "windows", (F.col("windows_found") / F.col("windows")).alias("coverage"), "slots", "slots_consistent", "excerpt")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their ids; all columns stay."""
    held = materialize(_held(docs, benchmark, "item_id", "text").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct())
    t1, t2 = text_key()
    return docs.join(broadcast_under(held, BROADCAST_ROWS), (t1 == F.col("__t1")) & (t2 == F.col("__t2")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
