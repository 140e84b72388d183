"""Main text of web pages by consensus paths of their host.

Each page is split into blocks of text, each with the innermost container it stands in. A container is
known by its generalised path: tags with their classes, digits replaced, so that pages of one template
share paths; paths are kept as hashes with their depth, and what a container holds is summed from the inside
out, so a page costs time in proportion to its length however deep it is nested. Every page scores its containers (share of the page's prose inside, links counted against
it, article-like tags and classes preferred); Spark adds the scores up by host and path, and the path
with the highest sum is the host's choice. Pages are then extracted again inside the chosen path. A page
without it, and pages without a host, use their own best container.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import written

from .common import sized

# Kinds of HTML elements and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts semantics annotation annotation-xml".split())
#: Parts that are left out but may stand in a line of text, so that the text around them stays one block.
EMBEDDED = frozenset("svg canvas object audio video annotation annotation-xml script style template".split())
INLINE |= MATH | EMBEDDED
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SKIPPED = frozenset("head button select option menu".split()) | RAW | EMBEDDED
DOUBTFUL = frozenset("nav header footer aside form dialog".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
SKIPPED_CLASSES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie consent disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Class names and ids of more than one word that are skipped as well: a place and a word, or a word and a part.
PLACES = "site page main top bottom left right global primary secondary post entry article blog user social cookie ad google".split()
PARTS = "area bar block body box button buttons container content form inner item links list menu nav panel section slot unit widget wrap wrapper".split()
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
GOOD_CLASSES = frozenset("article content entry main post story body text".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
P_BARRIERS = CONTAINERS | {"td", "th", "button"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_READ = re.compile("class|id|role", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z0-9]+")
SKIPPED_NAMES = SKIPPED_CLASSES | {f"{p}-{w}" for p in PLACES for w in SKIPPED_CLASSES} | {
    f"{w}-{p}" for w in SKIPPED_CLASSES for p in PARTS if w not in ("skip", "share")
} | {"skip-link", "skip-links", "share-buttons", "share-links", "nav-links", "related-posts", "related-articles"}


@lru_cache(maxsize=100_000)
def unwanted_name(name: str) -> bool:
    """Whether a whole class name or id, numbers at its end left out, is one of the skipped ones."""
    return "-".join(w for w in _SPLIT.split(name) if w and not w.isdigit()) in SKIPPED_NAMES


@dataclass
class Container:
    """A container element: the one around it (-1: none), its path and depth, whether its names are article-like,
    and whether it is or stands in an article or main."""

    outer: int
    path: int
    depth: int
    good: bool
    within: bool


@dataclass
class Element:
    tag: str
    skipped: bool
    path: int = 0
    depth: int = 0
    doubt: int = -1
    container: int = -1
    within: bool = False


@dataclass
class Doubt:
    """A container that a rule leaves out unless it turns out to hold the page: the doubtful one around it, whether
    it stands in an article or main, its tag, prose of its own, and whether an article or main is in it."""

    outer: int
    within: bool
    tag: str
    prose: int = 0
    article: bool = False


@dataclass
class Block:
    """A block of prose and the innermost container around it (-1: none)."""

    text: str
    container: int
    linked: int = 0
    doubt: int = -1


@dataclass
class Page:
    """The prose of a page: blocks in order, and its containers, outer ones first."""

    blocks: list[Block]
    containers: list[Container]


@dataclass
class _Reader:
    stack: list[Element] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))  # of each open tag in the stack
    breaks: list[int] = field(default_factory=list)  # places of tags that are not inline
    containers: list[Container] = field(default_factory=list)
    doubts: list[Doubt] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    embedded: int = 0  # parts of the same kind open inside the embedded part at the top

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else Element("", False)
            self.blocks.append(Block(text, top.container, min(self.linked, len(text)), top.doubt))
        self.parts, self.linked = [], 0

    def in_embedded(self) -> bool:
        return bool(self.stack) and self.stack[-1].skipped and self.stack[-1].tag in EMBEDDED

    def push(self, element: Element) -> None:
        self.places[element.tag].append(len(self.stack))
        if element.tag not in INLINE:
            self.breaks.append(len(self.stack))
        self.stack.append(element)

    def pop_to(self, at: int) -> None:
        if any(e.tag not in INLINE for e in self.stack[at:]):
            self.flush()
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag not in INLINE:
                self.breaks.pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open one of ``tags``; -1 where none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def implied_ends(self, tag: str) -> None:
        closed = ("p",) if tag in CLOSES_P else SAME_CLOSES.get(tag)
        if closed:
            at = self.last(closed)
            if at > self.last(P_BARRIERS if tag in CLOSES_P else BARRIERS[tag]):
                self.pop_to(at)

    def start(self, tag: str, attributes: str) -> None:
        if self.in_embedded():
            self.embedded += tag == self.stack[-1].tag and tag not in VOID and not attributes.endswith("/")
            return
        self.implied_ends(tag)
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        values: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(attributes) if _READ.search(attributes) or "hidden" in attributes.lower() else ():
            values.setdefault(name.lower(), html.unescape(value.strip("\"'")).lower())
        names = [*values.get("class", "").split(), *values.get("id", "").split()]
        words = set(_SPLIT.split(values.get("class", ""))) | set(_SPLIT.split(values.get("id", "")))
        outer = self.stack[-1] if self.stack else Element("", False)
        skipped = outer.skipped or tag in SKIPPED or "hidden" in values
        doubtful = tag in DOUBTFUL or values.get("role") in SKIPPED_ROLES or values.get("aria-hidden") == "true"
        unwanted = any(map(unwanted_name, names))
        main = tag in ("article", "main")
        doubtful = doubtful or unwanted and not main and tag not in ("body", "html")
        doubt = outer.doubt
        if doubtful and not skipped:
            self.flush()
            kind = "nav" if values.get("role") == "navigation" else tag
            self.doubts.append(Doubt(doubt, outer.within, kind))
            doubt = len(self.doubts) - 1
        elif main and doubt >= 0 and not skipped and not unwanted:
            self.doubts[doubt].article = True
        element = Element(tag, skipped, outer.path, outer.depth, doubt, outer.container, outer.within or main)
        if tag not in INLINE:
            classes = sorted({_DIGITS.sub("#", c) for c in values.get("class", "").split()})
            element.path, element.depth = path_below(outer.path, ".".join([tag, *classes])), outer.depth + 1
            if tag in CONTAINERS:
                good = main or values.get("role") in ("main", "article") or bool(words & GOOD_CLASSES)
                self.containers.append(Container(outer.container, element.path, element.depth, good, element.within))
                element.container = len(self.containers) - 1
        self.push(element)

    def end(self, tag: str) -> None:
        if self.in_embedded():
            if tag != self.stack[-1].tag:
                return
            if self.embedded:
                self.embedded -= 1
                return
        at = self.last((tag,))
        if at >= 0 and not (tag in INLINE and self.breaks and self.breaks[-1] > at):
            self.pop_to(at)

    def text(self, piece: str) -> None:
        if self.stack and self.stack[-1].skipped:
            return
        piece = html.unescape(piece)
        self.parts.append(piece)
        if self.places.get("a"):
            self.linked += len(piece.strip())


@lru_cache(maxsize=64)
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE)


def path_below(outer: int, step: str) -> int:
    """The path that one more step leads to."""
    return xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), outer) >> 1


def page_blocks(source: str | None) -> Page:
    """The prose blocks of a page in order; parts that are never main text are left out."""
    reader, at, source = _Reader(), 0, source or ""
    unclosed: set[str] = set()
    while at < len(source):
        found = _TOKEN.match(source, at)
        at = found.end()
        tag = found[2] or found[5]
        if tag:
            tag = tag.lower()
            if found[1] or found[4]:
                reader.end(tag)
                continue
            attributes = found[3] if found[2] else found[6]
            if tag in EMBEDDED and tag not in RAW and not reader.in_embedded():
                if tag not in unclosed and not _close(tag).search(source, at):
                    unclosed.add(tag)
                if tag in unclosed:  # it would hide the rest of the page
                    continue
            reader.start(tag, attributes)
            if tag in RAW:
                close = _close(tag).search(source, at)
                at = close.start() if close else len(source)
            elif attributes.endswith("/") and tag in ("svg", "math"):
                reader.end(tag)
        elif not found[0].startswith("<") or found[0] == "<":
            reader.text(found[0])
        elif found[0].startswith("<![CDATA["):
            reader.text(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
    reader.flush()
    return Page(without_doubtful(reader.blocks, reader.containers, reader.doubts), reader.containers)


def without_doubtful(blocks: list[Block], containers: list[Container], doubts: list[Doubt]) -> list[Block]:
    """The blocks outside of doubtful containers, and those in one that holds an article or main (not being part
    of one itself) or, navigation aside, more than half of the page's prose, links left out. What a doubtful
    container has is counted from the inside out. Where an article or main outside has a tenth of the prose, only
    forms come back: long comments below an article do not become the page's text."""
    if not doubts:
        return blocks
    total = articles = 0
    for block in blocks:
        prose = len(block.text) - block.linked
        total += prose
        if block.doubt >= 0:
            doubts[block.doubt].prose += prose
        elif block.container >= 0 and containers[block.container].within:
            articles += prose
    kept = [False] * len(doubts)
    for at in range(len(doubts) - 1, -1, -1):
        d = doubts[at]
        most = 2 * d.prose > total and d.tag != "nav"
        free = d.within or d.tag == "form" or 10 * articles < total
        kept[at] = d.prose > 0 and free and (most or d.article and not d.within)
        if kept[at] and d.outer >= 0:
            doubts[d.outer].prose += d.prose
            doubts[d.outer].article |= d.article
    for at, d in enumerate(doubts):  # outer ones come first
        kept[at] = kept[at] and (d.outer < 0 or kept[d.outer])
    return [b for b in blocks if b.doubt < 0 or kept[b.doubt]]


def container_scores(page: Page) -> dict[tuple[int, int], float]:
    """Score of each container path (depth and path): its share of the prose, links counted against it, times a
    preference."""
    total = sum(len(b.text) for b in page.blocks) or 1
    held, any_block = [0.0] * len(page.containers), [False] * len(page.containers)
    for block in page.blocks:
        if block.container >= 0:
            held[block.container] += (len(block.text) - 2 * block.linked) / total
            any_block[block.container] = True
    sums: dict[tuple[int, int], float] = defaultdict(float)
    liked: set[tuple[int, int]] = set()
    for at in range(len(page.containers) - 1, -1, -1):  # inner ones first
        c = page.containers[at]
        if not any_block[at]:
            continue
        sums[c.depth, c.path] += held[at]
        if c.good:
            liked.add((c.depth, c.path))
        if c.outer >= 0:
            held[c.outer] += held[at]
            any_block[c.outer] = True
    return {p: s * (1.3 if p in liked else 0.9 if p[0] < 3 else 1.0) for p, s in sums.items()}


def best_path(scores: dict[tuple[int, int], float]) -> int | None:
    best = max(scores, key=lambda p: (round(scores[p], 9), p), default=None)
    return best and best[1]


def blocks_inside(page: Page, path: int | None) -> list[Block]:
    """The blocks in a container of the path or in one inside of it."""
    inside: list[bool] = []
    for c in page.containers:
        inside.append(c.path == path or c.outer >= 0 and inside[c.outer])
    return [b for b in page.blocks if b.container >= 0 and inside[b.container]]


def main_text(page: Page, path: int | None) -> str:
    """The blocks inside ``path``; where no block is, those inside the page's own best container."""
    inside = blocks_inside(page, path) if path is not None else []
    if not inside:
        own = best_path(container_scores(page))
        inside = page.blocks if own is None else blocks_inside(page, own)
    return "\n".join(b.text for b in inside)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host``, ``path``: the container path with the highest sum of scores, of equal ones the deepest."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                sums: dict[tuple[str, int, int], float] = defaultdict(float)
                part = batch.iloc[at : at + 500]
                for host, source in zip(part.host, part.html, strict=True):
                    for (depth, path), score in container_scores(page_blocks(source)).items():
                        sums[host, depth, path] += score
                rows = pd.DataFrame(list(sums), columns=["host", "depth", "path"])
                yield rows.assign(score=list(sums.values()))

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host != ''")
    sums = votes.mapInPandas(vote, "host string, depth int, path long, score double").groupBy("host", "depth", "path").agg(
        F.round(F.sum("score"), 6).alias("score")
    )
    return sums.groupBy("host").agg(F.max(F.struct("score", "depth", "path")).alias("b")).select("host", "b.path")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for each page row.

    Null and empty html gives an empty text; a page without any container gives all its prose. Pages whose
    url is null or has no host choose for themselves. Repeated rows vote as often as they occur. Other columns of
    ``pages`` are ignored.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series(
                [main_text(page_blocks(s), None if p is None else int(p)) for s, p in zip(sources, paths, strict=True)],
                dtype=object,
            )

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # a path goes as text: in a column of numbers with nulls it would lose digits
    paths = written(host_paths(pages).select("host", F.col("path").cast("string").alias("path")), "host-paths")
    found = rows.join(sized(paths), "host", "left")
    return found.select("page_id", "url", extract("html", "path").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
