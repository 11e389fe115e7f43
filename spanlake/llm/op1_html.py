"""Main text of HTML pages by line-block distribution.

1. Markup is stripped into lines, one for each block of the page in page order. What the markup itself says is no article
   text (scripts, styles, forms, nav, aside, footer, a header outside an article, hidden parts) leaves one empty line. A
   line's length is its characters outside links; inside a marked article (article, main) it counts ARTICLE times.
2. Parts whose class or id is made of boilerplate words only (ad-slot, cookie-notice, post-comments; not share-price or
   overflow-hidden) are named. A name is a hint, weighed against the text: a named part that holds more than its share of
   all text is the page's text after all (layout names: half, others: nine tenths); otherwise its lines are empty.
3. Over every window of WINDOW lines the lengths are summed. A stretch begins at a surge, where the sum leaves nothing, and
   ends at a dive, where it falls back to nothing: WINDOW empty or link-only lines. From surge to dive all lines between
   the first and the last one with text of its own are kept, in order.
4. A stretch counts if its peak reaches PEAK of the page's highest, or if it lies in the same marked article as one that does:
   so short paragraphs after an advert stay, while a list of links inside the article is cut out, a teaser's article does not
   hide the text beside it, and short notices without a name fall away.

A line break within a block is white space. Each character is read a bounded number of times, so pages of any length and
any nesting take time in proportion.

Defined results: a null, empty or textless page gives an empty text; tags that are never closed end with the block around
them, unknown ones are inline; null ids and urls are carried through; repeated rows each give a row; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import table

WINDOW, PEAK, ARTICLE = 3, 0.3, 4
#: Shares of all text from which on a named part is the page's text: layout names, other names.
LAYOUT_SHARE, NAMED_SHARE = 0.5, 0.9
#: Elements by their role in HTML.
RAW = frozenset("script style template noscript iframe svg math object video audio canvas select textarea title datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("head nav footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar status".split())
#: Words of class and id names for what is not the article, those that layouts around an article bear too, and
#: words that say nothing by themselves.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "breadcrumb breadcrumbs comment comments commentlist disqus respond replies reply newsletter subscribe subscription signup login popup modal overlay share sharing "
    "social related recommended pagination pager skip hidden".split()
)
LAYOUT = frozenset("nav navbar navigation menu sidebar sidebars aside widget widgets footer header masthead topbar toolbar".split())
PLAIN = frozenset(
    "area bar block body bottom box button buttons container content entry form group icon icons inline inner item items left link links list main module outer page "
    "panel post posts primary right secondary section site slot text title top unit wrap wrapper".split()
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))|(?=[\s/]|$))", re.I)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_STOP = re.compile(r"[>\"']")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_GONE = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)


def name_share(value: str) -> float | None:
    """The share of the page's text from which on a part with this class or id is text after all; None for no name at all.

    A name is a token whose words are all boilerplate, layout or empty ones, one of the first two kinds among them."""
    shares = []
    for token in value.split():
        words = set(_WORD.findall(_CAMEL.sub(r"\1 \2", token).lower()))
        if words and words <= NAMED | LAYOUT | PLAIN and words & (NAMED | LAYOUT):
            shares.append(NAMED_SHARE if words & NAMED else LAYOUT_SHARE)
    return max(shares, default=None)


def _kind(name: str, attributes: str, in_article: bool) -> tuple[bool, float | None]:
    """Whether markup says that the element is no article text, and its name's share."""
    if name in SKIPPED or name == "header" and not in_article:
        return True, None
    share = None
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _GONE.search(value) or key == "role" and value.lower() in ROLES:
            return True, None
        if key in ("class", "id") and name not in ("html", "body", "main", "article", "header"):
            found = name_share(value)
            share = found if share is None else share if found is None else max(share, found)
    return False, share


def _tag_end(page: str, at: int) -> int:
    """Place of the '>' that ends the tag whose name ends at `at`: quotes after '=' are passed over if they are closed."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        at = m.end()
        if page[max(0, m.start() - 9) : m.start()].rstrip().endswith("="):
            close = page.find(m[0], at)
            if close >= 0:
                at = close + 1


@dataclass
class Line:
    text: str
    own: int  # characters outside links
    article: int  # number of the marked article around it, or 0
    part: int  # number of the innermost named part around it, or 0


@dataclass
class _Open:
    """An open element: what it adds to the state, and the inline elements that are open in it if it is a block."""

    name: str
    skipped: bool = False
    article: bool = False
    named: bool = False
    inline: dict[str, list[int]] = field(default_factory=dict)


class Stripper:
    """Reads a page into lines."""

    def __init__(self):
        self.lines: list[Line] = []
        self.named: list[tuple[float, int]] = [(0.0, 0)]  # by number of the named part: its share, the named part around it
        self.stack: list[_Open] = []
        self.blocks: list[int] = []  # places of blocks in the stack
        self.count: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.links = self.skip = self.inside = self.articles = self.article = 0
        self.part = 0

    def flush(self, empty: bool = False) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text or empty:
            self.lines.append(Line(text, max(0, len(text) - self.linked), self.article, self.part))
        self.parts.clear()
        self.linked = 0

    def pop(self) -> None:
        x = self.stack.pop()
        self.count[x.name] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        else:
            self.block().inline[x.name].pop()
        self.skip -= x.skipped
        self.links -= x.name == "a"
        if x.article or x.named:
            self.flush()
        if x.article:
            self.inside -= 1
            self.article = self.article if self.inside else 0
        if x.named:
            self.part = self.named[self.part][1]

    def block(self) -> _Open:
        return self.stack[self.blocks[-1]] if self.blocks else self.root

    root = _Open("")

    def close(self, name: str) -> None:
        if not self.count.get(name):
            return
        if name in BLOCK:
            while self.stack[-1].name != name:
                self.pop()
            self.pop()
        else:  # an inline element is not closed from inside a block that it holds
            places = self.block().inline.get(name)
            if places:
                while len(self.stack) > places[-1] + 1:
                    self.pop()
                self.pop()

    def open(self, name: str, attributes: str) -> None:
        if name == "body":  # ends a head that was left open
            while self.stack:
                self.pop()
        if name in ("p", "li") and self.blocks and self.block().name == name:
            self.close(name)
        if name == "a" and self.links:
            self.close("a")
        skipped, share = _kind(name, attributes, self.inside > 0)
        if self.skip:
            share = None
        elif skipped:
            self.flush(empty=True)
        article = name in ("article", "main") and not self.skip and not skipped
        named = share is not None
        if named:
            self.flush()
            self.named.append((share, self.part))
            self.part = len(self.named) - 1
        x = _Open(name, skipped, article, named)
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        else:
            self.block().inline.setdefault(name, []).append(len(self.stack))
        self.stack.append(x)
        self.count[name] = self.count.get(name, 0) + 1
        self.skip += skipped
        self.links += name == "a"
        if article:
            if not self.inside:
                self.articles += 1
                self.article = self.articles
            self.inside += 1

    def text(self, raw: str) -> None:
        if raw and not self.skip:
            shown = html.unescape(raw)
            self.parts.append(shown)
            if self.links:
                self.linked += len(" ".join(shown.split()))

    def read(self, page: str) -> list[Line]:
        self.root = _Open("")
        at, size, endless = 0, len(page), set()
        while at < size:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= size:
                break
            after = page[lt + 1]
            m = _NAME.match(page, lt + 1 + (after == "/")) if after == "/" or after.isalpha() else None
            if m is None and after not in "!?":
                self.text(page[at : lt + 1])  # a bare sign
                at = lt + 1
                continue
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                self.text(page[at:lt])
                at = size if end < 0 else end + 3
                continue
            end = page.find(">", lt) if m is None else _tag_end(page, m.end())
            if end < 0:
                break  # no tag ends after this place: the rest is text
            self.text(page[at:lt])
            at = end + 1
            if m is None:
                continue
            name, closing, attributes = m[0].lower(), after == "/", page[m.end() : end]
            if name in RAW:
                if not closing and not attributes.endswith("/") and name not in endless:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                    if close:
                        at = close.end()
                    elif name in ("script", "style"):
                        return self.done("")
                    else:
                        endless.add(name)
                continue
            if name == "br":
                self.text(" ")
                continue
            if name in BLOCK:
                self.flush()
            if closing:
                self.close(name)
            elif name not in VOID:
                self.open(name, attributes)
        return self.done(page[at:])

    def done(self, rest: str) -> list[Line]:
        self.text(rest)
        self.flush()
        return self.lines


def boilerplate_of(lines: list[Line], named: list[tuple[float, int]]) -> list[bool]:
    """By number of the named part, whether its name holds: it has less than its share of the text. Other names are judged
    before layout names, which are measured against what the others leave."""
    gone = [False] * len(named)
    for kind in (NAMED_SHARE, LAYOUT_SHARE):
        held, total = [0] * len(named), 0
        for x in lines:
            if not gone[x.part]:
                held[x.part] += len(x.text)
                total += len(x.text)
        for n in range(len(named) - 1, 0, -1):  # a part's number is above that of the part around it
            held[named[n][1]] += held[n]
        for n in range(1, len(named)):
            share, around = named[n]
            gone[n] = gone[n] or gone[around] or share == kind and held[n] < share * total
    return gone


def stretches(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, end, highest window sum) from each surge to its dive: maximal runs of windows with text, from the first
    line to the last one that has any."""
    half, found, start, peak = window // 2, [], None, 0
    total = sum(lengths[:half])
    for i in range(len(lengths) + 1):
        total += lengths[i + half] if i + half < len(lengths) else 0
        total -= lengths[i - half - 1] if i - half - 1 >= 0 else 0
        inside = i < len(lengths) and total > 0
        if inside and start is None:
            start, peak = i, 0
        if inside:
            peak = max(peak, total)
        elif start is not None:
            full = [k for k in range(start, i) if lengths[k]]
            found.append((full[0], full[-1] + 1, peak))
            start = None
    return found


def main_text(page: str | None) -> str:
    strip = Stripper()
    lines = strip.read(page or "")
    gone = boilerplate_of(lines, strip.named)
    lengths = [0 if gone[x.part] else x.own * (ARTICLE if x.article else 1) for x in lines]
    found = stretches(lengths)
    top = max((peak for *_, peak in found), default=0)
    strong = {lines[i].article for a, b, peak in found if peak >= PEAK * top for i in range(a, b)} - {0}
    whole = lambda i, peak: peak >= PEAK * top or lines[i].article in strong
    return "\n".join(lines[i].text for a, b, peak in found for i in range(a, b) if lines[i].text and not gone[lines[i].part] and whole(i, peak))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
