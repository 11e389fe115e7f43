"""Each corpus operator against brute force or a fixed property, and on odd rows: nulls, blanks, repeats, no rows."""

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from spanlake.llm import op1_html, op2_lm, op3_fingerprints, op4_sharding, op5_quality, op6_neardup, op7_language, op8_mixing, op9_decontamination, op10_licenses
from spanlake.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, shard string, label string"
LONG = "word " * 60_000
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", "en", "a", 3), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, "All rights reserved CC-BY", None, None, 24), (None, "no id here", "fr", "b", 10),
    (5, "123 456 !!", "en", "b", 10), (6, LONG, "en", "b", len(LONG)), (7, "Ünï çödé “quotes” 🙂 naïve text", "de", "b", 30), (3, "another text for the same id", "fr", "a", 28),
]


def crc(x, m):
    return zlib.crc32(str(x).encode()) % m


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def run(name, spark, frame):
    if name == "op5":
        return op5_quality.classify(frame, labels(spark, [(1, 1, 0), (3, 0, 0), (3, 1, 0), (4, None, 0), (6, 7, 0), (99, 1, 1)]))
    if name == "op9":
        bench = spark.createDataFrame([(0, None), (1, ""), (2, "one two"), (3, "word word word word word word"), (None, "no id here at all but longer than five words")], "item_id long, text string")
        return op9_decontamination.leaks(frame, bench)
    return {"op2": op2_lm.score, "op3": op3_fingerprints.fingerprint, "op4": op4_sharding.shard_documents, "op6": op6_neardup.near_duplicates, "op7": op7_language.identify, "op8": op8_mixing.mix_documents, "op10": op10_licenses.scan_documents}[name](frame)


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_odd_rows_and_no_rows(spark, odd, name):
    got = run(name, spark, odd).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in ODD)
    assert run(name, spark, odd.where("1 = 0")).collect() == []


def test_decontamination_of_odd_rows(spark, odd):
    assert {(r["doc_id"], r["item_id"]) for r in run("op9", spark, odd).collect()} == {(6, 3)}
    assert run("op9", spark, odd.where("1 = 0")).collect() == []
    assert op9_decontamination.leaks(odd, spark.createDataFrame([], "item_id long, text string")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="with-sidebar">
<header><h2>Site</h2></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><div class="layout-sidebar"><article class="post">
<h1>Title &amp; more</h1><p>First   <b>bold</b>&nbsp;text<br>line.<p>1 &lt; 2 &#8212; x<div class="ad">Buy</div><aside>Side</aside><form><p>Mail</p></form><ul><li>One<li>Two</ul>
<p>Last.</p><section id="comments"><p>Nice!</p></section></article></div><footer>&copy; x</footer></body></html>"""


def test_html():
    assert op1_html.main_text(PAGE) == "Title & more\nFirst bold text line.\n1 < 2 — x\nOne\nTwo\nLast."
    assert op1_html.main_text(None) == op1_html.main_text("") == op1_html.main_text("<p></p>") == ""
    assert op1_html.main_text("<div><a href=x>Menu</a></div><div>" + "long text " * 30 + "</div><p>Short end.</p><div><a href=y>More</a></div>").endswith("Short end.")
    assert op1_html.main_text("a < b and <c") == "a < b and <c"
    assert op1_html.main_text("<head><title>x</title><body><p>Text of the page") == "Text of the page"


def test_line_blocks_decide_in_marked_articles_too():
    text = "<p>" + "long text " * 30 + "</p>"
    links = "<ul>" + "".join(f"<li><a href=/{k}>Story {k}</a>" for k in range(6)) + "</ul>"
    assert op1_html.main_text(f"<article>{text}{links}<p>Last.</p></article>").split("\n")[1:] == ["Last."]  # a dive among links
    assert op1_html.main_text(f"<article>{text}<p><a href=x>One link</a></p><p>Last.</p></article>").split("\n")[1:] == ["One link", "Last."]
    teaser = "<article><h2>Teaser</h2></article>" + "<div>x</div>" * 0 + f"<div>{text * 6}</div>"
    assert len(op1_html.main_text(teaser)) > 6 * 290  # a teaser's article hides nothing
    notice = "<p>Short notice without a name.</p>" + "<hr><form></form>" * 3
    assert op1_html.main_text(f"{notice}<article>{text}</article>") == ("long text " * 30).strip()  # its peak is too low


def test_names_are_hints():
    text = "<p>" + "long text " * 30 + "</p>"
    for kept in ('<section id="related-work"><p>Kept.</p></section>', '<p class="share-price">Kept.</p>', '<div data-hidden="false">Kept.</div>', '<div class="overflow-hidden">Kept.</div>'):
        assert op1_html.main_text(f"<article>{text}{kept}</article>").endswith("\nKept."), kept
    for gone in ('<div class="ad-slot">Gone.</div>', '<div id="cookieNotice">Gone.</div>', '<div class="big post-comments">Gone.</div>', "<div hidden>Gone.</div>", '<div style="display: none">Gone.</div>'):
        assert "Gone" not in op1_html.main_text(f"<article>{text}{gone}{text}</article>"), gone
    assert op1_html.main_text('<div class="overflow-hidden"><p>Body.</p></div>') == op1_html.main_text('<div class="sidebar"><p>Body.</p></div>') == "Body."
    comments = '<div class="comments"><p>' + "comment " * 100 + "</p></div>"
    assert op1_html.main_text(comments + f'<div class="sidebar"><article>{text}</article></div>') == ("long text " * 30).strip()


@pytest.mark.parametrize("piece", ["<a ", '<a "x', '<a ="x', "<div>", "<svg>", "<b>", "</b>", "<i></b>", '<p class="ad">', '<div class="ad">', "<article>", "<form>", "<!-- ", "&", "<li><a>x", "word <p>"])
def test_very_long_hostile_pages_take_time_in_proportion(piece):
    import time

    began = time.time()
    page = "<p>Start</p><b>" + piece * (1_000_000 // len(piece)) + "</b>" * 1000 + "<p>End</p>"
    op1_html.main_text(page)
    assert time.time() - began < 30


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", PAGE), (None, "u", PAGE)], "page_id long, url string, html string")
    got = op1_html.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 58, 58] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert op1_html.extract(pages.where("1 = 0")).collect() == []


def test_html_of_all_pages(spark, sf):
    import html
    import re

    for r in q.QUERIES["op1_html_line_blocks"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>|<br>", body)]
        assert r["text"] == "\n".join(filter(None, blocks))


def test_language_model(spark, docs, rows):
    got = {r["doc_id"]: r for r in op2_lm.score(docs).collect()}
    c = collections.Counter()
    tokens = {i: [*words(r["text"]), b""] for i, r in rows.items()}
    for i, t in tokens.items():
        if crc(i, 7) != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), abs=1e-6)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 7) == 2, len(t), sum(c[x] > 0 for x in t), n)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_against_plain_softmax(spark, docs, rows, monkeypatch):
    """Each text's score token by token from the trained parameters; the parameters averaged in a tree."""
    import numpy as np

    monkeypatch.setattr(op2_lm, "FAN", 2)
    training = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2").select("doc_id", F.col("text").cast("binary").alias("text"))
    _, v = op2_lm.gather(training)
    c1, c2, out, bias = (np.asarray(p, float) for p in op2_lm.train(training, spark.sparkContext.broadcast(v)))
    got = {r["doc_id"]: r["score"] for r in op2_lm.score(docs).collect()}
    counts = collections.Counter(x for i, r in rows.items() if crc(i, 7) != 2 for x in words(r["text"]))
    head = {op2_lm.xxhash.xxh64_intdigest(w) - (1 << 63): w for w in counts}
    number = {head[h]: k for k, h in enumerate(v.hashes[: op2_lm.WORDS].tolist())}
    group_n, group_v = collections.Counter(), collections.Counter()
    for w, c in counts.items():
        if w not in number:
            group_n[op2_lm.shared_class(w)] += c
            group_v[op2_lm.shared_class(w)] += 1
    for i in list(rows)[:25]:
        total, u, v_ = 0.0, op2_lm.END, op2_lm.END
        for w in [*words(rows[i]["text"]), None]:
            k = op2_lm.END if w is None else number.get(w, op2_lm.WORDS + op2_lm.shared_class(w))
            s = (c1[u] + c2[v_]) @ out.T + bias
            total += (s[k] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            if w is not None and w not in number:
                g = op2_lm.shared_class(w)
                total += math.log10((counts[w] + 1) / (group_n[g] + group_v[g] + 1))
            u, v_ = v_, k
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-2)


def test_language_model_is_normalised():
    import numpy as np

    rng = np.random.default_rng(0)
    parameters = [rng.normal(size=(op2_lm.CLASSES, op2_lm.DIM)) for _ in range(3)] + [rng.normal(size=op2_lm.CLASSES)]
    by_u, by_v, norm = op2_lm.tables(parameters)
    for u, v in ((0, 0), (3, 200), (511, 511)):
        assert np.exp(by_u[u].astype(float) + by_v[v] - norm[u, v]).sum() == pytest.approx(1, abs=1e-3)


def test_rare_words_meet_their_counts_in_the_join(spark, docs, monkeypatch):
    want = {r["doc_id"]: r["base_score"] for r in op2_lm.score(docs).collect()}
    monkeypatch.setattr(op2_lm, "HOT", 50)
    got = {r["doc_id"]: r["base_score"] for r in op2_lm.score(docs).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_fingerprints(spark, docs, rows):
    import hashlib

    import numpy as np

    order = sorted(rows)
    got = {r["doc_id"]: r for r in op3_fingerprints.fingerprint(docs, ranges=7).collect()}
    similar = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) if len(a) or len(b) else 1.0
    by_text = collections.defaultdict(set)
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        a, b = rows[i]["text"] or "", rows[after]["text"] or ""
        new = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        x, y, z = (op3_fingerprints.digests(t.encode()) for t in (a, new, b))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(new.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(similar(x, y)), pytest.approx(similar(x, z)))
        by_text[a].add(r["fingerprint"])
        by_text[new].add(r["edited_fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_peeling_recovers_differences_of_any_size():
    import numpy as np

    rng = np.random.default_rng(1)
    for size, other in ((0, 0), (1, 0), (5, 3), (400, 0), (3000, 2500)):
        common = rng.integers(0, 1 << 62, 50, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in (size, other))
        got = op3_fingerprints.likeness([a], [b])[0][0]
        assert got == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))


def test_differing_paragraphs_are_recovered():
    left, right = "One line.\nThe second one.\nLast.", "One line.\nThe other one.\nLast."
    gone, new = op3_fingerprints.differences(left.encode(), right.encode())
    whole = lambda d: {p for k, p in d.items() if k & op3_fingerprints.PARAGRAPH}
    assert whole(gone) == {b"The second one."} and whole(new) == {b"The other one."}
    assert op3_fingerprints.differences(b"", b"") == ({}, {})
    dense = ("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 100).encode()  # no space in 1,800 bytes
    assert all(len(p) <= 51 and p.decode() for k, p in op3_fingerprints.cells_of(dense).items() if not k & 1)


def test_many_rows_of_one_id_or_none_are_dealt_out(spark):
    rows = [(None, "same"), (7, "also the same"), (7, "also the same")] * 300 + [(8, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op3_fingerprints.fingerprint(df, ranges=9).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {None: 300, 7: 600, 8: 50}
    assert sum(r["near_next"] == 1 for r in got if r["doc_id"] in (None, 7)) == 898


def check_shards(got, most):
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] for r in by.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * most
    return by


def test_sharding(docs, rows):
    got = op4_sharding.shard_documents(docs).collect()
    for r in got:
        text = (rows[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    check_shards(got, max(r["size"] for r in got))


def test_a_group_of_copies_is_split_between_shards(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text again").otherwise(F.concat(F.lit("own text "), F.col("id"))).alias("text"))
    by = check_shards(op4_sharding.shard_documents(df).collect(), 20)
    assert len(by) == 16


def test_rows_that_are_equal_in_all_columns_are_split_too(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 2900, "").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("text"))
    assert len(check_shards(op4_sharding.shard_documents(df).collect(), 6)) == 16
    assert len(check_shards(op4_sharding.shard_texts(df).collect(), 6)) == 16


def test_small_groups_of_copies_stay_together(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of a pair "), F.floor(F.col("id") / 2)).alias("text"))
    long = df.unionByName(spark.createDataFrame([(9999, "y" * 400)], "doc_id long, text string"))
    got = op4_sharding.shard_texts(long).collect()
    check_shards(got, 401)
    where = collections.defaultdict(set)
    for r in got:
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(op4_sharding, "SAMPLES", 1)
    monkeypatch.setattr(op4_sharding, "OVERFULL", 1.2)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    keys = op4_sharding.materialize(op4_sharding._keyed(df).select(F.lit(5).cast("long").alias("__s"), *op4_sharding.KEY))
    _, per = op4_sharding._split(keys, 10_000, 2)
    assert sum(n for _, n in per.values()) == 2000 and max(s for s, _ in per.values()) <= 1.2 * 10_000 / 64

def test_quality(spark, sf):
    got = {r["doc_id"]: r for r in q.QUERIES["op5_ftrl_quality"](spark, sf).collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in truth.items() if crc(i, 5) == 0]
    pairs = [(a > b) for a, y in held if y for b, z in held if not z]
    assert not pairs or sum(pairs) / len(pairs) > 0.9


def plain_ftrl(rows, epochs):
    """The same updates number by number, with dicts."""
    import numpy as np

    z, n, rng = collections.defaultdict(float), collections.defaultdict(float), np.random.default_rng(3)
    o, bias = op5_quality, 1 << op5_quality.BITS

    def weight(i):
        l1 = 0 if i == bias else o.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((o.BETA + math.sqrt(n[i])) / o.ALPHA + o.L2 * (i != bias))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            label, counts, words_ = rows[r]
            x = {i: c * o.SCALE / max(words_, 1) for i, c in counts.items()} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / o.ALPHA * w[i]
                n[i] += g * g
    return weight


def test_quality_against_plain_updates(spark):
    import random

    rng = random.Random(9)
    good, bad = ["The old river was calm.", "They met, again, in spring."], ["BUY NOW 777 !!! $$$", "click click click http://x.y/z?q=1"]
    texts = {i: " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randrange(1, 9))) for i in range(60)} | {60: "", 61: None}
    truth = [(i, i % 2, 0) for i in range(50)]
    got = op5_quality.classify(spark.createDataFrame(list(texts.items()) + [(3, texts[3])] * 5, "doc_id long, text string"), labels(spark, truth * 3)).collect()
    shapes = op5_quality.Shapes()
    feats = {}
    for i, t in texts.items():
        found, n = op5_quality.indexes((t or "").encode(), shapes)
        feats[i] = (collections.Counter(found.tolist()), n)
    rows = sorted(((i, y) for i, y, _ in truth if crc(i, 5) != 0), key=lambda r: r)
    weight = plain_ftrl([(y, *feats[i]) for i, y in rows], op5_quality.EPOCHS)
    for r in got:
        counts, n = feats[r["doc_id"]]
        want = 1 / (1 + math.exp(-(sum(c * weight(k) for k, c in counts.items()) * op5_quality.SCALE / max(n, 1) + weight(1 << op5_quality.BITS))))
        assert r["score"] == pytest.approx(want, abs=1e-5) and r["predicted"] == (r["score"] >= 0.3)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1


def test_long_shapes_differ_after_their_start():
    a, b = b"aA" * 20 + b"7", b"aA" * 20 + b"!"
    shapes = op5_quality.Shapes()
    assert shapes[a] & 0xFFFFFFFF != shapes[b] & 0xFFFFFFFF


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def test_near_duplicates_of_the_documents(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op6_neardup.near_duplicates(docs).collect()}
    assert got == brute_components({i: r["text"] for i, r in rows.items()})


def test_near_duplicates_in_chains_and_beside_the_limit(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts, edited = {}, list(base)
    for i in range(60):  # a chain: neighbours are alike, the ends are not
        edited = list(edited)
        edited[rng.randrange(120)] = f"x{i}"
        texts[i] = " ".join(edited)
    for i in range(60, 160):  # a star: each far enough from the others and some near enough to the base
        star = list(base)
        for _ in range(rng.choice((2, 4, 6))):
            star[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        texts[i] = " ".join(star)
    texts |= {200: texts[3], 201: texts[3].upper(), 202: "a b", 203: "a b", 204: "a b c", 205: "", 206: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op6_neardup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def template_pages(n, shared=104, own=20, seed=6):
    """Pages of one template: most of each is shared, not enough of it; a few pairs are alike enough."""
    import random

    rng = random.Random(seed)
    core = [f"c{i}" for i in range(shared)]
    texts = {i: " ".join([*core, *(f"o{rng.randrange(10**9)}" for _ in range(own))]) for i in range(n)}
    for i in range(0, n, 50):
        w = texts[i].split()
        texts[10**6 + i] = " ".join([*w[:-3], "other", "last", "words"])
    return texts


def test_pages_of_one_template_are_not_paired_with_each_other(spark, monkeypatch):
    texts = template_pages(400)
    made = []
    monkeypatch.setattr(op6_neardup, "_meet", lambda s, l, meet=op6_neardup._meet: made.append(s.alias("s").join(l.alias("l"), ["token", "size"]).count()) or meet(s, l))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op6_neardup.near_duplicates(df).collect()}
    assert got == brute_components(texts)
    assert sum(made) < 400 * 20  # rows that meet at all; pairs are 80,000


def test_hot_keys_in_salted_parts_give_the_same(spark, monkeypatch):
    texts = template_pages(60, shared=120, own=8) | template_pages(30, shared=40, own=4, seed=8)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(op6_neardup, "PARTNERS", 3)
    monkeypatch.setattr(op6_neardup, "MEMBERS", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op6_neardup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_copies_without_ids_go_too(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (5, text), (7, text), (None, "alone"), (None, None), (9, "b"), (9, "a"), (9, "a")]
    got = op6_neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, "alone"), (5, text), (9, "a")]


def test_registers_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:])
    ra, rb, both = op6_neardup.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    got = op6_neardup.joint_similarity(ra[None], rb[None], np.array([2000.0]), np.array([2500.0]))[0]
    assert abs(got - 0.5) < 0.15


def test_language(docs, rows):
    got = {r["doc_id"]: r for r in op7_language.identify(docs).collect()}
    held = [i for i in got if crc(i, 4) == 2]
    assert all(got[i]["held_out"] == (crc(i, 4) == 2) for i in got)
    assert sum(got[i]["lang_pred"] == rows[i]["lang"] for i in held) > 0.95 * len(held)


def test_language_against_plain_decoding(docs, rows):
    """Each text's margins and losses number by number, from the trained weights."""
    model = op7_language.train(docs)
    names, code, w, b = model
    got = {r["doc_id"]: r for r in op7_language.identify(docs).collect()}
    for i in list(rows)[:40]:
        text = (rows[i]["text"] or "").encode()
        flat = " ".join("".join(chr(c) if c >= 128 or chr(c).isalpha() else " " for c in text.lower()).split()).encode("latin-1")
        flat = b" " + flat + b" "
        grams = collections.Counter((((flat[k] | flat[k + 1] << 8 | flat[k + 2] << 16) * 0x9E3779B1) & 0xFFFFFFFF) >> 19 for k in range(len(flat) - 2))
        if not any(c.isalpha() for c in rows[i]["text"] or ""):
            continue
        total = sum(grams.values())
        margin = [float(b[j]) + sum(math.sqrt(100 * c / total) * float(w[k, j]) for k, c in grams.items()) for j in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-float(code[g, j]) * margin[j])) for j in range(len(margin))) for g in range(len(names))]
        best = min(range(len(names)), key=lambda g: loss[g])
        assert got[i]["lang_pred"] == names[best]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-3)
        assert got[i]["distance"] == pytest.approx(loss[best] / len(margin), abs=1e-3)


def test_texts_with_letters_stay_where_nothing_is_learnt(odd):
    kept = op7_language.keep_identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 3, 3, 3, 4, 6, 7]


def test_many_languages_fit_the_driver(spark):
    import random

    rng = random.Random(1)
    stems = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(30)] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(stems[i % 40]) for _ in range(40)), f"l{i % 40}") for i in range(1200)], "doc_id long, text string, lang string")
    got = op7_language.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got)
    code = op7_language.codewords(300)
    assert min((code[i] != code[j]).sum() for i in range(300) for j in range(i)) >= 23


def test_codewords_are_apart():
    import numpy as np

    for n in (1, 2, 4, 5, 12):
        code = op7_language.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code}) == n
        if n > 5:
            assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 5
    assert np.abs(code).min() == 1


def test_texts_without_letters_are_undetermined(spark, odd):
    got = {r["doc_id"]: r["lang_pred"] for r in op7_language.identify(odd).collect()}
    assert got[0] == got[1] == got[2] == got[5] == "und" and got[6] != "und"


def fill(sizes, weights, budget=1.5, most=2.0):
    target, free = {s: 0.0 for s in sizes}, set(sizes)
    left = budget * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / total >= most * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / total for s in free}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        free -= full
    return target


def test_mixture(docs, rows):
    got = {r["doc_id"]: r for r in op8_mixing.mix_documents(docs).collect()}
    sizes = collections.Counter()
    for i, r in rows.items():
        assert got[i]["size"] == len(words(r["text"]))
        sizes[r["source"]] += got[i]["size"]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, taken = fill(sizes, weights), collections.Counter()
    for i, r in got.items():
        s = rows[i]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(r["size"] for i, r in got.items() if rows[i]["source"] == s) for s in sizes)
    assert got == {r["doc_id"]: r for r in op8_mixing.mix_documents(docs).collect()}


def test_small_slices_give_targets_too(docs, monkeypatch):
    monkeypatch.setattr(op8_mixing, "SLICE_ROWS", 2)
    by = collections.defaultdict(list)
    for r in op8_mixing.mix_documents(docs, "source").collect():
        by[r["source"]].append(r)
    assert all(abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x) for x in by.values())


def test_weights_lead_to_more_of_the_better(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("quality"), F.col("id").alias("text_hash"))
    big = df.unionByName(df.limit(20).withColumn("source", F.lit("r")))
    taken = {r["even"]: r["n"] for r in op8_mixing.mix(big).where("source = 's' and copies > 1").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.count("*").alias("n")).collect()}
    assert taken[True] > taken.get(False, 0)


def test_slices_hold_few_rows_at_any_quality_and_repeats_are_one(spark, monkeypatch):
    monkeypatch.setattr(op8_mixing, "SLICE_ROWS", 50)
    seen = []
    fill = op8_mixing._fill
    monkeypatch.setattr(op8_mixing, "_fill", lambda rows: seen.append(rows.groupBy("__source").count().agg(F.max("count")).first()[0]) or fill(rows))
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "r").otherwise("s").alias("source"), (F.col("id") % 17 + 1).alias("size"), F.when(F.col("id") % 100 == 0, 1.0).otherwise(0.05).alias("quality"), F.col("id").alias("text_hash"))
    same = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), F.lit(0.05).alias("quality"), F.lit(5).cast("long").alias("text_hash"))
    for frame in (df, df.unionByName(same)):
        got = op8_mixing.mix(frame).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
        assert all(abs(r["taken"] - r["target"]) <= 17 for r in got) and sum(r["n"] for r in got) == frame.count()
    assert len(seen) == 2 and max(seen) <= 50


def test_the_sample_follows_the_exponential_keys(spark):
    """Of one source, what a prefix in order of -ln(u) / quality holds, by sorting it whole."""
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 13 + 1).alias("size"), ((F.col("id") % 7 + 1) / 7).alias("quality"), F.col("id").alias("text_hash"))
    u = (F.xxhash64("doc_id", "text_hash", F.lit("mix")).cast("double") / F.lit(2.0**64) + 0.5)
    order = [(r["k"], r["doc_id"], r["size"]) for r in df.withColumn("k", -F.log(u) / F.col("quality")).collect()]
    got = {r["doc_id"]: r["copies"] for r in op8_mixing.mix(df).collect()}
    left = 0.5 * sum(s for *_, s in order)
    for _, i, s in sorted(order):
        assert got[i] == 1 + (s <= left) or s < 2 * left < 2 * s
        left -= s * (s <= left)


ITEM = "A train leaves Berlin at 9 am with 120 people and travels 300 km to Munich where it stops for 15 minutes before it returns to Berlin again"


def test_reparameterised_questions_are_found(spark):
    other = ITEM.replace("Berlin", "Paris").replace("300 km", "450 miles").replace("120", "77")
    mixed = "A train leaves Rome at 9 am with 120 people and travels 300 km to Oslo where it stops for 15 minutes before it returns to Lima again"
    plain = "An entirely different sentence about trains that leave stations and people who travel to see their families in winter and in spring"
    df = spark.createDataFrame([(1, ITEM), (2, f"Before. {other}. After."), (3, plain), (4, ITEM.upper()), (5, ITEM[:60])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert {r["doc_id"] for r in op9_decontamination.leaks(df, bench).collect()} == {1, 2, 4}
    recurring = spark.createDataFrame([(9, ITEM + " and Berlin and Berlin")], "item_id long, text string")
    one = lambda x: spark.createDataFrame([(1, x)], "doc_id long, text string")
    assert op9_decontamination.leaks(one(other + " and Paris and Paris"), recurring).count() == 1
    assert op9_decontamination.leaks(one(mixed + " and Cork and Bonn"), recurring).count() == 0  # one name, four values
    towns = spark.createDataFrame([(9, "From Rome we walked to Oslo then on to Lima and later to Cork where Bonn met Kiel near Metz")], "item_id long, text string")
    assert op9_decontamination.leaks(one("From Rome we walked to Rome then on to Rome and later to Rome where Rome met Rome near Rome"), towns).count() == 0  # four names, one value


def test_short_items_are_matched_whole(spark):
    bench = spark.createDataFrame([(1, "Green frogs"), (2, "7 8 9 10 11 12 13"), (3, "Rome"), (4, "..."), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Many green frogs live here"), (2, "green little frogs"), (3, "7 8 9 10 11 12"), (4, "6 7 8 9 10 11 12 13 14"), (5, "to Rome."), (None, "in rome")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op9_decontamination.leaks(docs, bench).collect()} == {(1, 1), (4, 2), (5, 3), (None, 3)}
    assert [r["doc_id"] for r in op9_decontamination.drop_leaks(docs, bench).collect()] == [2, 3]


def brute_leak(text, item):
    """Both rules by comparing every place of the text with every place of the item."""
    tokens = op9_decontamination.Tokens()
    (ci, wi), (cd, wd) = ([x.tolist() for x in op9_decontamination.template((x or "").encode(), tokens)] for x in (item, text))
    good = [i for i in range(len(ci) - 4) if sum(a == b for a, b in zip(ci[i : i + 5], wi[i : i + 5])) >= 3]
    if not good:
        return bool(wi) and any(wd[k : k + len(wi)] == wi for k in range(len(wd) - len(wi) + 1))
    hits = {}
    for i in good:
        for k in range(len(cd) - 4):
            if cd[k : k + 5] == ci[i : i + 5]:
                hits.setdefault(k - i, set()).add(i)
    for shift in (0, 4):
        bands = {}
        for d, places in hits.items():
            bands.setdefault((d + shift) // 8, {})[d] = places
        for held in bands.values():
            if 2 * len(set().union(*held.values())) < len(good):
                continue
            slots = {(i + j, wi[i + j], wd[i + j + d]) for d, places in held.items() for i in places for j in range(5) if ci[i + j] != wi[i + j]}
            ways = [collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)]
            for _, a, b in slots:
                ways[0][a][b] += 1
                ways[1][b][a] += 1
            if all(sum(max(c.values()) for c in w.values()) >= 0.8 * len(slots) for w in ways):
                return True
    for d, places in hits.items():
        covered = {i + j for i in places if wi[i : i + 5] == wd[i + d : i + d + 5] for j in range(5)}
        for i in places:
            if set(range(i, i + 13)) <= covered and sum(ci[j] == wi[j] for j in range(i, i + 13)) >= 8:
                return True
    return False


def test_leaks_against_brute_force(spark, sf, rows):
    import random

    rng = random.Random(5)
    bench = [(b["item_id"], b["text"]) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bench += [(100, ITEM), (101, ITEM.replace("Berlin", "Lyon")), (102, "Answer this: which of the old towns has 3 gates and 2 towers"), (103, "Answer this: which of the old towns has 4 bridges")]
    texts = [r["text"] for r in rows.values()][:60]
    for _, item in bench[-24:]:
        w = item.split()
        for _ in range(4):
            cut = w[rng.randrange(len(w) // 2) :][: rng.randrange(8, 40)]
            if rng.random() < 0.5 and len(cut) > 6:
                cut.insert(rng.randrange(len(cut)), "inserted")
            texts.append(f"Before this. {' '.join(cut)} {rng.choice(texts[:60])[:80]}" if rng.random() < 0.8 else " ".join(cut))
    got = {(r["doc_id"], r["item_id"]) for r in op9_decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, item in bench if brute_leak(t, item)}
    assert got == want and len(want) > 40


def test_anchors_meet_every_way_to_hold_an_item():
    import random

    rng = random.Random(3)
    for _ in range(200):
        places = sorted(rng.sample(range(60), rng.randrange(1, 40)))
        owners = [rng.randrange(1, 9) for _ in places]
        chosen = op9_decontamination.anchors_of(owners, places, False)
        assert len(places) - sum(chosen) < op9_decontamination.least(len(places))
        for a in places:
            assert any(c for p, c in zip(places, chosen) if a <= p <= a + 8)


def test_leaks_against_whole_items(spark, sf, rows):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    flat = lambda t: " ".join((t or "").lower().split())
    want = {(i, b["item_id"]) for i, r in rows.items() for b in bench if flat(b["text"]) in flat(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in q.QUERIES["op9_template_decontamination"](spark, sf).collect()}
    assert want <= got


def test_a_crowded_bitmap_and_shuffled_joins_give_the_same(spark, sf, monkeypatch):
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in q.QUERIES["op9_template_decontamination"](spark, sf).collect()}
    want = pairs()
    monkeypatch.setattr(op9_decontamination, "MOST_BITS", 8)
    monkeypatch.setattr(op9_decontamination, "BROADCAST_ROWS", 0)
    assert pairs() == want


def brute_licenses(text):
    import re

    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((k, label) for p, label in op10_licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))


def test_licenses(spark, odd, docs, rows):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    for r in op10_licenses.scan_documents(docs).collect():
        assert tuple(r[n] for n in names) == brute_licenses(rows[r["doc_id"]]["text"])
    extra = [(1, "cc by cc by CC-BY all rights reserved"), (2, "by cc"), (3, "cc"), (4, "General Public\nLICENSE"), (5, "Licensed under the new Apache License, Version 2.0"), (6, None)]
    got = {r["doc_id"]: r for r in op10_licenses.scan_documents(spark.createDataFrame(extra, "doc_id long, text string")).collect()}
    assert all(tuple(got[i][n] for n in names) == brute_licenses(t) for i, t in extra)
    assert got[1]["n_base"] == 4 and got[5]["labels"] == "apache-2.0" and 0.8 <= got[5]["score"] < 1 and got[6]["labels"] == ""


def test_license_texts_of_any_length(spark):
    long = " ".join(f"w{i}" for i in range(200))
    words_ = long.split()
    docs = spark.createDataFrame([(1, long), (2, " ".join(words_[:170])), (3, " ".join(words_[:90] + ["x"] + words_[90:])), (4, " ".join(words_[:100])), (None, ""), (None, "")], "doc_id long, text string")
    spans = op10_licenses.license_spans(docs, ["doc_id"], texts={"long": long}).where("kind = 'text'").collect()
    assert {r["doc_id"]: (r["votes"], r["total"]) for r in spans} == {1: (199, 199), 2: (169, 199), 3: (198, 199)}
    marks = op10_licenses.license_spans(docs, ["doc_id"]).where("kind = 'mark' and doc_id is null").collect()
    assert [r["copies"] for r in marks] == [2]


def test_excerpts_of_long_items_are_found(spark):
    item = [f"word{i}" for i in range(500)]
    slots = [x for i in range(40) for x in ((f"word{i}", "7", "km", "Rome") if i % 10 else ("plain",))]
    cuts = [item[100:300], item[200:220], item[487:], item[200:212], item[200:206] + ["x"] + item[207:215], slots[:60]]  # the last has hardly a plain word
    docs = spark.createDataFrame([(n, f"before this {' '.join(c)} and after") for n, c in enumerate(cuts)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (8, " ".join(slots + item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op9_decontamination.leaks(docs, bench).collect()}
    assert got == {(n, i) for n in (0, 1, 2) for i in (8, 9)}
