"""Near-duplicates by SetSketch registers, linked exactly: documents whose sets of five-word shingles have a Jaccard
similarity of 0.75 or more, and the components of those links.

1. One pass over the texts gives each document's set of 64-bit shingle hashes, a key of that set, and M registers:
   register i is floor(1 - log_b x_i), x_i the least of exponential values that hash i gives the shingles (exponentially
   spaced truncated minima). Equal sets are one class from here on; its least id stands for it.
2. BANDS bands of ROWS registers are hashed; classes that share a band value are candidates. At a similarity of 0.75 a
   pair misses all bands with a chance of 1e-6, at 0.8 of 1e-9.
3. In each bucket every member is tried with the bucket's least id only, as many pairs as members. Verified links give
   first components.
4. What the stars have missed is found by an exact join of all members' sets: with each set's shingles ordered by how many
   members have them, rarest first, two sets that are similar enough share one among their first n - 0.75 n + 1, at places
   that leave enough of both. Only pairs of different components count, and of each shingle's pairs only those with a
   member outside its largest component. So large groups of near copies, which step 3 has joined, are never multiplied
   out, nor are large groups of texts that are alike but not enough, whose rarest shingles are their own.
5. A pair is tried cheaply first: by sizes (exact) and by the low bits of the registers (beyond five standard
   deviations only), then the joint likelihood of the registers estimates the similarity (same margin), then the whole
   sets are intersected. Only that last comparison makes a link. A set that has many partners is sent out in salted copies.
6. Components: large-star and small-star rounds on the links, each written to the shared folder.

Defined results: a null or blank text has an empty set and is linked with nothing; fewer than five words make one
shingle; rows with one id are one document, linked by any of its texts; a row without id is linked with nothing, has no
component and is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.common import WordHashes, bounded_batches, broadcast_under, giving_back, materialize, table, with_row_key

#: Fixed values of the contract.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Registers, their base and rate; bands of registers; margins of the estimates in standard deviations.
M, BASE, RATE, BANDS, ROWS, MARGIN = 256, 1.02, 20.0, 51, 5, 5.0
#: Shingles that are sketched at a time; ids up to which their table is broadcast; ratio of sizes that one step joins; partners
#: of a set, and members of a shingle, that go to one task.
CHUNK, BROADCAST_IDS, STEP, PARTNERS, MEMBERS = 1 << 17, 1_000_000, 1.05, 500, 2_000

SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>, b0 long, b1 long, b2 long, b3 long"
SET = "rep long, n long, registers binary, shingles binary"


def shingle_hashes(words: list[bytes], hashes: WordHashes):
    """The sorted distinct 64-bit hashes of the shingles."""
    import numpy as np

    if not words:
        return np.empty(0, np.uint64)
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
    w = hashes.of(words)
    n = max(1, len(w) - SHINGLE + 1)
    s = np.full(n, len(w) if len(w) < SHINGLE else 0, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        s += w[j : j + n] * factors[j]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def _constants():
    import numpy as np

    draw = np.random.default_rng(20_240_601)
    return draw.integers(0, 1 << 31, M, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, M, np.uint32)


def registers(sets: list):
    """SetSketch registers of sets, none of them empty, as a matrix of uint16."""
    import numpy as np

    factor, shift = _constants()
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least, t = np.empty((M, len(sets)), np.uint32), np.empty_like(keys)
    for i in range(M):
        np.multiply(keys, factor[i], out=t)
        np.add(t, shift[i], out=t)
        least[i] = np.minimum.reduceat(t, starts)
    x = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65_535).astype(np.uint16)


def _band_keys(regs):
    import numpy as np

    parts = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = (key ^ parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sets(batches, flush) -> Iterator:
    """Calls flush(ids, sets) for each chunk of documents and passes on its batches."""
    hashes, ids, sets, held = WordHashes(), [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            sets.append(shingle_hashes((text or b"").lower().split(), hashes))
            held += len(sets[-1]) + 64
            if held >= CHUNK:
                yield flush(ids, sets)
                ids, sets, held = [], [], 0
    if ids:
        yield flush(ids, sets)


def _signatures(batches) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    def flush(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, bands, bits = [None] * len(ids), [[]] * len(ids), np.zeros((len(ids), 4), np.int64)
        if full:
            regs = registers([sets[i] for i in full])
            bits[full] = np.ascontiguousarray(np.packbits((regs & 1).astype(np.uint8), axis=1)).view(np.int64)
            for i, b in zip(full, _band_keys(regs), strict=True):
                keys[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), b
        columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns + [pa.array(bits[:, j]) for j in range(4)], ["doc_id", "n_shingles", "set_key", "bands", "b0", "b1", "b2", "b3"])

    yield from _sets(batches, flush)


def _whole_sets(batches) -> Iterator:
    import pyarrow as pa

    def flush(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        regs = registers([sets[i] for i in full]) if full else []
        columns = [pa.array([ids[i] for i in full], pa.int64()), pa.array([len(sets[i]) for i in full], pa.int64())]
        return pa.RecordBatch.from_arrays(columns + [pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([sets[i].tobytes() for i in full], pa.binary())], ["rep", "n", "registers", "shingles"])

    yield from _sets(batches, flush)


def joint_similarity(left, right, n_left, n_right):
    """Likeliest Jaccard similarity, on a grid of 1/128, for rows of registers of sets whose sizes are known."""
    import numpy as np

    above, below = (left > right).sum(1)[:, None], (left < right).sum(1)[:, None]
    u = (n_left / (n_left + n_right))[:, None]
    grid = np.minimum(np.arange(129) / 128, np.minimum(u / (1 - u), (1 - u) / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - (1 - u) * grid), p(1 - u - u * grid)
    tiny = 1e-12
    likelihood = above * np.log(more + tiny) + below * np.log(less + tiny) + (M - above - below) * np.log(np.maximum(1 - more - less, tiny))
    return grid[np.arange(len(grid)), likelihood.argmax(1)]


def _links(batches) -> Iterator:
    """Pairs that the likelihood leaves possible and whose whole sets are similar enough."""
    import numpy as np
    import pyarrow as pa

    limit = NUMERATOR / DENOMINATOR
    least = limit - MARGIN * (limit * (1 - limit) / M) ** 0.5
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            a, b, na, nb, ra, rb, sa, sb = (c.to_pylist() for c in part.columns)
            left, right = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, M) for r in (ra, rb))
            likely = joint_similarity(left, right, np.array(na, float), np.array(nb, float)) >= least
            found = []
            for i in np.flatnonzero(likely):
                both = len(np.intersect1d(np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64), assume_unique=True))
                if DENOMINATOR * both >= NUMERATOR * (na[i] + nb[i] - both):
                    found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _possible(a: str, b: str):
    """Sizes allow the similarity, and so do the registers' low bits: of pairs at the limit, half the rest agree too."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    limit = NUMERATOR / DENOMINATOR
    differ = (1 - limit) / 2
    most = M * differ + MARGIN * (M * differ * (1 - differ)) ** 0.5
    bits = sum((F.bit_count(F.col(f"{a}.b{j}").bitwiseXOR(F.col(f"{b}.b{j}"))) for j in range(4)), F.lit(0))
    return (F.least(n_a, n_b) * DENOMINATOR >= F.greatest(n_a, n_b) * NUMERATOR) & (bits <= int(most))


def _salted(many: DataFrame, one: DataFrame, key: list[str], spread: str, most: int) -> DataFrame:
    """many joined with one on key. A key of more than `most` rows of many is dealt over tasks by the column spread, and its
    row of one is repeated as often."""
    counts = many.groupBy(*key).agg(F.count("*").alias("__c")).where(F.col("__c") > most)
    hot = materialize(counts.select(*key, F.ceil(F.col("__c") / most).cast("long").alias("__parts")))
    if not hot.limit(1).count():
        return many.join(one, key)
    hot = broadcast_under(hot, BROADCAST_IDS)
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    left = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), parts)).drop("__parts")
    right = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return left.join(right, [*key, "__salt"]).drop("__salt")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"), F.col("shingles").alias("sb"))
    whole = _salted(_salted(pairs, left, ["a"], "b", PARTNERS), right, ["b"], "a", PARTNERS).select("a", "b", "na", "nb", "ra", "rb", "sa", "sb")
    return materialize(whole.mapInArrow(giving_back(_links), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """id and component (its least id) of every id in links (a, b), by large-star and small-star rounds."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        root = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(root, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = materialize(moved.unionByName(root.select("v", F.col("m").alias("u"))).where("v <> u").distinct())
        was, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if was == state:
            break
    stars = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return stars.unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())


def _tokens(batches) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            rep, n, shingles = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
            tokens = np.frombuffer(b"".join(shingles), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, n)), pa.array(np.repeat(n, n)), pa.array(tokens)], ["rep", "n", "token"])


def _prefixes(sets: DataFrame) -> DataFrame:
    """rep, n, token, place: the shingles by which a set can be found, places counted from 0 in order of rarity.

    Shingles that no other member has stand first and are only counted."""
    tokens = sets.select("rep", "n", "shingles").mapInArrow(giving_back(_tokens), "rep long, n long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep", "n")
    met = tokens.join(shared, "token").withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1)
    return materialize(met.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)).select("rep", "n", "token", "place"))


def _across(prefixes: DataFrame, traits: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs a < b of different components that share a shingle of their prefixes and may be similar enough."""
    known = prefixes.join(traits.drop("n"), "rep").join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    each = known.groupBy("token", "component").agg(F.count("*").alias("held"))
    mixed = each.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("held", "component")).alias("largest")).where("parts > 1").drop("parts")
    mixed = materialize(known.join(mixed, "token"))
    # a pair's smaller set (or either of equal ones) is met by the larger one, each through its own places
    total, bound = NUMERATOR + DENOMINATOR, lambda n: F.ceil(n * NUMERATOR / DENOMINATOR)
    rest = F.col("n") - F.col("place")
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(STEP)) + 1e-9).cast("int")
    small = mixed.where(rest * total >= 2 * NUMERATOR * F.col("n")).withColumn("size", step(F.col("n")))
    most = F.least(F.col("n"), F.floor(rest * total / NUMERATOR) - F.col("n"))
    large = mixed.where(most >= bound(F.col("n"))).withColumn("size", F.explode(F.sequence(step(bound(F.col("n"))), step(most))))
    pairs = _meet(small.where("component <> largest"), large).unionByName(_meet(small.where("component = largest"), large.where("component <> largest")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _meet(small: DataFrame, large: DataFrame) -> DataFrame:
    """x, y: members of different components that share a token at places that leave enough, and may be similar enough."""
    fields = ["rep", "n", "place", "component", "b0", "b1", "b2", "b3"]
    side = lambda rows, name: rows.select("token", "size", F.struct(*fields).alias(name))
    counts = lambda rows, name: rows.groupBy("token", "size").agg(F.count("*").alias(name))
    hot = counts(small, "s").join(counts(large, "l"), ["token", "size"]).where(F.greatest("s", "l") > MEMBERS)
    hot = broadcast_under(materialize(hot.select("token", "size", F.ceil(F.col("s") / MEMBERS).cast("int").alias("sp"), F.ceil(F.col("l") / MEMBERS).cast("int").alias("lp"))), BROADCAST_IDS)
    own = lambda name, p: F.pmod(F.xxhash64(f"{name}.rep"), F.coalesce(p, F.lit(1))).cast("int")
    every = lambda p: F.explode(F.sequence(F.lit(0), F.coalesce(p, F.lit(1)) - 1))
    # a hot group is a grid: each member of one side meets each part of the other
    x = side(small, "x").join(hot, ["token", "size"], "left").withColumn("i", own("x", "sp")).withColumn("j", every("lp")).drop("sp", "lp")
    y = side(large, "y").join(hot, ["token", "size"], "left").withColumn("j", own("y", "lp")).withColumn("i", every("sp")).drop("sp", "lp")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = rest * (NUMERATOR + DENOMINATOR) >= (F.col("x.n") + F.col("y.n")) * NUMERATOR
    met = x.join(y, ["token", "size", "i", "j"]).where((F.col("x.component") != F.col("y.component")) & enough & _possible("x", "y"))
    return met.select(F.col("x.rep").alias("x"), F.col("y.rep").alias("y"))


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of every row."""
    rows = bounded_batches(docs).select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    signed = materialize(rows.mapInArrow(giving_back(_signatures), SIGNATURE))
    usable = signed.where("doc_id is not null and set_key is not null")
    classes = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = usable.join(classes, ["set_key"]).where("doc_id = rep")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last").drop("last")
    members = materialize(banded.join(shared, "band").distinct())
    ids = broadcast_under(materialize(members.select("rep").distinct()), BROADCAST_IDS)
    traits = materialize(signed.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "b0", "b1", "b2", "b3").join(ids, "rep", "left_semi"))
    sets = materialize(rows.join(ids, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(giving_back(_whole_sets), SET))

    pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    first = pairs.join(traits.alias("x"), F.col("a") == F.col("x.rep")).join(traits.alias("y"), F.col("b") == F.col("y.rep"))
    stars = materialize(first.where(_possible("x", "y")).select("a", "b").distinct())
    links = _verified(stars, sets)

    joined = materialize(components(links))
    more = _across(_prefixes(sets), traits, joined).join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(materialize(more), sets))

    component = materialize(components(links))
    known = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").join(component, F.col("rep") == F.col("id"), "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return known.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"), F.col("rep").alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of its least id; all columns stay. A row without id is a document of its own
    that counts after those with ids, so copies without ids go too."""
    own = F.shiftrightunsigned(F.col("__row"), 2) + F.lit(1 << 62)
    named = with_row_key(docs, "__row").withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), own))
    found = near_duplicates(named, "__doc").groupBy(F.col("doc_id").alias("__id")).agg(F.count_if("kept").alias("count"))
    # the ids that go, mostly fewer than those that stay: while they fit a broadcast, no text has to be shuffled
    others = materialize(found.where("count <> 1"))
    same = F.col("__doc") == F.col("__id")
    often = others.where("count > 1")
    kept = named.join(broadcast_under(others.select("__id"), BROADCAST_IDS), same, "left_anti")
    if often.limit(1).count():  # rows that share an id: the one with the least text stands for them
        first = named.join(often, same, "left_semi").select("__doc", "text", "__row").groupBy("__doc").agg(F.min(F.struct("text", "__row"))["__row"].alias("__first"))
        first = first.withColumnRenamed("__doc", "__of")
        kept = kept.unionByName(named.join(first, (F.col("__doc") == F.col("__of")) & (F.col("__row") == F.col("__first")), "left_semi"))
    return kept.drop("__row", "__doc")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
