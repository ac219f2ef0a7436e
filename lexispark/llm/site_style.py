"""HTML extraction with a site style tree.

Distinct pages of one host (copies, which show the same elements and texts
outside denied ones, count once) are merged element by element: an element is
known by its path of tags and class or id names.  For every element the tree holds how many
pages have it, which child sequences they show (presentation) and which texts
they put there (content).  Presentation importance is the entropy of the child
sequences; content importance is one less the mean entropy with which a text
spreads over the pages.

Two things follow from the tree.  A branch goes if its content and the
presentation around it are both of low importance: the same text in the same
place, page after page.  And an element whose children differ freely from page
to page, while those of the elements around it are one template, is where the
site puts its articles: other branches of the template go, whatever they are
called and whatever changing texts they hold, but for headings and paragraphs
beside such an element.

HTML's own semantics come first: elements whose tag or role says that they are
no part of an article (and those whose whole class or id name does, on hosts
with few pages the only sign) have importance zero beforehand, and where a page
has an article or main element, the article lies in it.

What a page adds to the tree is shuffled by host and digest, packed, so that
copies meet; counts are then combined in each task before they are shuffled, so
a host with a third of all pages is summed like any other.  HTML itself is
shuffled only if the removed paths of all hosts are too large for Spark to
broadcast.  Parsing takes time in proportion to a page's length.

Defined results: null or empty html gives an empty text; pages without a host
are judged by semantics and names alone; truncated markup ends where it ends;
repeated rows each get the same answer; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import hashlib
import html as references
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, fresh, slices, sole_cache, written
from lexispark.llm.url_filter import host_of

# What the HTML standard says of elements, and names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - frozenset("html body caption dd dt legend li optgroup option tbody td tfoot th thead tr summary".split()) | {"li", "dd", "dt"}
SCOPES = frozenset("html body article aside section div main nav footer header form td th table ul ol dl blockquote".split())
NO_ARTICLE_TAGS = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_ARTICLE_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments disqus cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget toolbar pagination pager login search respond reply replies".split())
#: Parts of names that add nothing to what a name says; a name counts if it has a boilerplate part and no others than these.
NAME_FILLERS = frozenset("site main page global top bottom left right first last box bar list item wrap wrapper container block area section inner outer primary secondary text content header links link button buttons form message policy slot unit zone user users reader readers visitor visitors byline".split())
#: Names of an article element that is not the page's own.
OTHER_ARTICLES = frozenset("comment comments reply replies teaser teasers related recommended promo promoted sponsored ad advert advertisement".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MAIN_TAGS = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[^a-z]+")
JOINED = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_say(names: str, what: frozenset[str]) -> bool:
    """Some whole class or id name consists of parts that say what, and fillers; capitals begin a part, too."""
    parts = [{*NAMES.split(JOINED.sub(" ", name).lower())} - {""} for name in names.split()]
    return any(p & what and p <= what | NAME_FILLERS for p in parts)


SIGNATURES: dict[str, tuple[str, bool, bool]] = {}


def signature(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in its path, whether names deny it anywhere, and whether they call it a header."""
    known = SIGNATURES.get(key := f"{tag} {attributes}")
    if known is None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        roles = {*found.get("role", "").lower().split()}
        hidden = "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes)))
        denied = tag in NO_ARTICLE_TAGS or hidden or bool(roles & NO_ARTICLE_ROLES) or (tag not in ("html", "body", "article", "main") and names_say(names, NO_ARTICLE_NAMES)) or (tag == "article" and names_say(names, OTHER_ARTICLES))
        stable = ".".join(sorted(x for x in names.lower().split() if not re.search(r"\d", x)))
        known = f"{tag}.{stable}" if stable else tag, denied, tag == "header" or names_say(names, frozenset(("header",)))
        if len(SIGNATURES) > 50_000:
            SIGNATURES.clear()
        SIGNATURES[key] = known
    return known


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    denied: bool = False
    main: bool = False
    low: bool = False
    #: Inside a region where the site puts its articles, and around one.
    region: bool = False
    around: bool = False
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    """A run of text inside one block, with the element it stands in, that element's parent, and the parent of its heading or paragraph."""

    element: Element
    parent: Element
    heading: Element | None
    text: str


def path_hash(parent: int, name: str) -> int:
    """64 bits of a name on top of its parent's path."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8, key=parent.to_bytes(8, "little")).digest(), "little")


PATHS: dict[tuple[int, str], int] = {}


def known_path(parent: int, name: str) -> int:
    got = PATHS.get((parent, name))
    if got is None:
        if len(PATHS) > 100_000:
            PATHS.clear()
        PATHS[parent, name] = got = path_hash(parent, name)
    return got


class Page:
    """The elements that are open, and the text blocks and styles (path, hash of the child sequence) found so far."""

    def __init__(self, low: frozenset[int], regions: frozenset[int]):
        self.low, self.regions = low, regions
        self.stack = [Element("", 0xCBF29CE484222325)]
        self.blocks: list[Block] = []
        self.styles: list[tuple[int, int]] = []
        self.buffer: list[str] = []
        #: Depths of open elements by tag, and of those that end tags from within don't reach across (table cells apart).
        self.depths: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.cells: list[int] = []

    def text(self, run: str) -> None:
        self.buffer.append(references.unescape(run))

    def flush(self) -> None:
        if not self.buffer:
            return
        text = SPACE.sub(" ", "".join(self.buffer)).strip()
        self.buffer.clear()
        if text:
            stack = self.stack
            tops = [d[-1] for t in HEADINGS if (d := self.depths.get(t))]
            heading = stack[max(tops) - 1] if tops else None
            self.blocks.append(Block(stack[-1], stack[-2] if len(stack) > 1 else stack[-1], heading, text))

    def open(self, tag: str, name: str, denied: bool, header: bool) -> None:
        top = self.stack[-1]
        path, main = known_path(top.path, name), top.main or tag in MAIN_TAGS
        e = Element(tag, path, top.denied or denied or (header and not main), main, top.low or path in self.low, top.region or path in self.regions)
        if e.region and not top.region:
            for above in reversed(self.stack):
                if above.around:
                    break
                above.around = True
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            (self.cells if tag in ("td", "th") else self.scopes).append(len(self.stack))
        self.stack.append(e)

    def close(self, depth: int) -> None:
        stack = self.stack
        while len(stack) > depth:
            e = stack[-1]
            if e.tag in BLOCKS:
                self.flush()
            stack.pop()
            self.depths[e.tag].pop()
            if e.tag in SCOPES:
                (self.cells if e.tag in ("td", "th") else self.scopes).pop()
            self.styles.append((e.path, path_hash(7, " ".join(e.children))))

    def end(self, tags: set[str] | frozenset[str], across_scopes: bool = False, across_cells: bool = False) -> None:
        """Close the innermost open element of one of the tags, and all within it, unless a scope lies between."""
        found = max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)
        if not found:
            return
        if not across_scopes and ((self.scopes and self.scopes[-1] > found) or (not across_cells and self.cells and self.cells[-1] > found)):
            return
        self.close(found)


def parse(page: str | None, low: frozenset[int] = frozenset(), regions: frozenset[int] = frozenset()) -> tuple[list[Block], list[tuple[int, int]]]:
    """Text blocks in page order, and (path, hash of the child sequence) of every element."""
    out = Page(low, regions)
    if not page:
        return out.blocks, out.styles
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            out.text(page[at:])
            break
        if m.start() > at:
            out.text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            out.end({tag}, across_scopes=tag in SCOPES)
            continue
        if tag == "br":
            out.buffer.append(" ")
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            out.end(CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set()), across_cells=tag == "tr")
        if tag in BLOCKS:
            out.flush()
        name, denied, header = signature(tag, m[3])
        out.stack[-1].children.append(name)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = size if end is None else page.find(">", end.start()) + 1 or size
            continue
        out.open(tag, name, denied, header)
    out.flush()
    out.close(1)
    return out.blocks, out.styles


@dataclass(frozen=True)
class Settings:
    #: Distinct pages of a host that must show an element before it is judged by what they put there.
    pages: int = 8
    content: float = 0.25
    presentation: float = 0.6
    #: Child sequences that an element must show, as the exponential of their entropy, to be where articles are put.
    variety: float = 5.0


#: kind, path, feature: what a page adds to its host's style tree.
FEATURE = "<BQQ"
STATISTICS = "host string, path long, kind byte, feature long"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def judged_paths(pages: DataFrame, s: Settings) -> DataFrame:
    """(host, path, region) from the style trees of all hosts: branches to remove, and regions of articles; pages: host, html."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("paths", PATHS.clear)
        for batch in slices(batches):
            hosts: list[str] = []
            packs: list[bytes] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, styles = parse(page)
                seen = {(p, 1, h) for p, h in styles}
                told = [b for b in blocks if not b.element.denied]
                seen |= {(b.element.path, 2, path_hash(11, b.text)) for b in told}
                seen |= {(b.parent.path, 3, b.element.path) for b in told}
                if seen:
                    hosts.append(host)
                    packs.append(b"".join(struct.pack(FEATURE, kind, p, f) for p, kind, f in sorted(seen)))
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in packs]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(packs, pa.binary())], ["host", "digest", "features"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for host, features in zip(batch.column("host").to_pylist(), batch.column("features").to_pylist(), strict=True):
                seen = [(signed(p), kind, signed(f)) for kind, p, f in struct.iter_unpack(FEATURE, features)]
                rows += [(host, *x) for x in seen]
                rows += [(host, p, 0, 0) for p in {p for p, kind, _ in seen if kind == 1}]
            a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int8()), pa.array(d, pa.int64())], ["host", "path", "kind", "feature"])

    once = pages.where("host != ''").mapInArrow(observe, "host string, digest binary, features binary").groupBy("host", "digest").agg(F.first("features").alias("features"))
    counts = once.select("host", "features").mapInArrow(unpack, STATISTICS).groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "style-counts")
    tree = written(
        counts.where("kind < 3").groupBy("host", "path").agg(
            F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
            F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("shown"),
            F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("shown_log"),
            F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("texts"),
            F.sum(F.when(F.col("kind") == 2, F.col("n") * F.log("n"))).alias("texts_log"),
        ).where(F.col("pages") >= s.pages),
        "style-tree",
    )
    # Entropies relative to their greatest value, the logarithm of the number of pages.
    tree = tree.select(
        "host",
        "path",
        (1 - F.col("texts_log") / F.col("texts") / F.log("pages")).alias("content"),
        ((F.log("shown") - F.col("shown_log") / F.col("shown")) / F.log("pages")).alias("presentation"),
        F.exp(F.log("shown") - F.col("shown_log") / F.col("shown")).alias("variety"),
    )
    around = counts.where("kind = 3").select("host", F.col("path").alias("parent"), F.col("feature").alias("path")).distinct()
    judged = tree.where(F.col("content") < s.content).select("host", "path").join(around, ["host", "path"])
    parents = tree.select("host", F.col("path").alias("parent"), "presentation")
    low = judged.join(parents, ["host", "parent"], "left").where(F.coalesce("presentation", F.lit(0.0)) < s.presentation).select("host", "path").distinct()
    regions = tree.where(F.col("variety") >= s.variety).select("host", "path")
    return low.withColumn("region", F.lit(False)).union(regions.withColumn("region", F.lit(True)))


def main_text(page: str | None, low: frozenset[int] = frozenset(), regions: frozenset[int] = frozenset(), semantics: bool = True) -> str:
    """The blocks of the article, by the tree's judgement and the page's semantics (which can be left out, to see what the tree does)."""
    blocks, _ = parse(page, low, regions)
    kept = [b for b in blocks if not b.element.low and not (semantics and b.element.denied)]
    if semantics and any(b.element.main for b in kept):
        kept = [b for b in kept if b.element.main]
    elif any(b.element.region for b in kept):
        kept = [b for b in kept if b.element.region or (b.heading is not None and b.heading.around)]
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame, settings: Settings = Settings(), *, url: str = "url", html: str = "html", name: str = "text") -> DataFrame:
    """pages' columns, then the main text (under a fresh name if pages has that one)."""
    bounded_batches(pages)
    host, low, regions, got = fresh(pages, "host", "low", "regions", name)
    rows = pages.withColumn(host, host_of(F.col(url)))
    found = judged_paths(rows.select(F.col(host).alias("host"), F.col(html).alias("html")), settings)
    paths = lambda region: F.array_sort(F.collect_set(F.when(F.col("region") == region, F.col("path"))))
    found = written(found.groupBy("host").agg(paths(False).alias("low"), paths(True).alias("regions")), "judged-paths")

    @F.arrow_udf("string")
    def text_of(bodies: pa.Array, lows: pa.Array, regions: pa.Array) -> pa.Array:
        sole_cache("paths", PATHS.clear)
        sets: dict[tuple, frozenset[int]] = {}
        out = []
        for body, *both in zip(bodies.to_pylist(), lows.to_pylist(), regions.to_pylist(), strict=True):
            for key in (known := [tuple(x or ()) for x in both]):
                if key not in sets:
                    sets[key] = frozenset(x & 0xFFFFFFFFFFFFFFFF for x in key)
            out.append(main_text(body, *(sets[key] for key in known)))
        return pa.array(out, pa.string())

    found = found.select(F.col("host").alias(host), F.col("low").alias(low), F.col("regions").alias(regions))
    out = rows.join(found, host, "left").withColumn(got, text_of(F.col(html), F.col(low), F.col(regions)))
    return out.select(*pages.columns, got)
