"""Operator 10: main text of pages by a maximum-scoring subsequence of words and tags.

A page is cut into tags and runs of words.  A word's score is the sum of log-odds of what
it stands in: its block, the elements around it and the names of these; marked content is
one such feature.  A tag scores negative, the more the rarer it is in articles.  All are
counted on labelled pages (pages that mark their article with ``article`` or ``main``),
with small priors from common names for what the labelled pages do not show.  One linear
scan finds the contiguous region with the largest sum, and its borders decide: text
outside is never returned, so headers, footers, sidebars and notices around an article go
by their scores alone.  Inside the region, containers that articles hold without being
text (asides, forms, adverts, comments and the like) are left out.

Blocks are joined in page order by one newline; white space inside a block becomes one
space; character references are decoded.

Defined results.  Null or empty html, or a page without a positive score: empty text.
Unclosed comments and raw elements end with the page; a tag with an unclosed quote ends at
the next ``>``.  Of regions with one sum the first, and of those the shortest, is taken.
Repeated rows are each returned.  Without labelled pages the priors alone decide.  Extra
columns are ignored.

Scale.  One pass without a shuffle, linear in a page's length.  The weights are fitted on
about ``TRAIN_PAGES`` labelled pages of at most ``TRAIN_CHARS`` characters, those whose
hash is below a bound that follows from their number.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

TRAIN_PAGES, TRAIN_CHARS = 400, 200_000

_IN_TAG = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|select)\b(?:{_IN_TAG}|[^>]*)>.*?(?:</\1\s*>|\Z)"
    rf"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:({_IN_TAG})(?:>|\Z)|([^>]*)(?:>|\Z))",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and names of containers that an article may hold and that are not its text.
INNER_TAGS = frozenset("nav aside form button dialog menu fieldset option object audio video canvas".split())
INNER_NAMES = frozenset(
    "ad ads advert advertisement adverts banner comment comments disqus newsletter popup promo promoted promotion related replies reply share sharing "
    "social sponsor sponsored subscribe toolbar widget widgets signup".split()
)
#: Those that stand around articles: a prior for the scan, which alone decides on them.
OUTER_TAGS = frozenset("header footer head".split())
OUTER_NAMES = frozenset(
    "alert breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright footer header login masthead menu menubar modal nav navbar "
    "navigation notice notices notification pagination search sidebar tags".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_NAMES = frozenset("article content main post story entry".split())
#: Containers of any kind of text: only their names and their own blocks tell something.
PLAIN_TAGS = frozenset("div section ul ol li p table thead tbody tr td th dl dt dd figure figcaption blockquote pre center html body #".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be missing: a start tag of the second kind ends them.
CLOSED_BY = {"p": None, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    """An element that is open: whether it lies in marked content, in a part that is left out, in an article's header; its features."""

    __slots__ = ("tag", "parent", "content", "left_out", "heading", "features", "score")

    def __init__(self, tag, names, parent):
        self.tag, self.parent, self.score = tag, parent, None
        own = tag in CONTENT_TAGS or (tag in ("div", "section", "td") and bool(names & CONTENT_NAMES) and not names & (INNER_NAMES | OUTER_NAMES))
        within = parent is not None and parent.content
        self.content = own or within
        self.heading = tag in HEADINGS or (parent is not None and parent.heading)
        inner = tag in INNER_TAGS or (tag not in INLINE and tag not in CONTENT_TAGS and bool(names & INNER_NAMES)) or (within and (tag == "footer" or bool(names & OUTER_NAMES) and "header" not in names and tag not in INLINE))
        header = within and (tag == "header" or "header" in names) and tag not in INLINE and tag not in HEADINGS
        above = parent.left_out if parent else ""
        if tag in CONTENT_TAGS and above == "inner" and not within:
            above = ""  # an article in a container that is named like an advert is an article
        # of an article's own header only the headings are text
        self.left_out = "inner" if inner or above == "inner" else "header" if header or above == "header" else ""
        features = set(parent.features) if parent else set()
        if tag not in INLINE:
            features = {f for f in features if not f.startswith("block ")} | {f"block {tag}"}
        if tag not in PLAIN_TAGS and tag not in HEADINGS:
            features.add(f"in {tag}")
        features |= {f"in {tag}.{n}" for n in names if tag not in INLINE}
        if own:
            features.add("content")
        self.features = features if parent is None or features != parent.features else parent.features

    def dropped(self) -> bool:
        return self.left_out == "inner" or (self.left_out == "header" and not self.heading)


def items(page: str):
    """("t", tag, node, opens) and ("w", text, node) of a page in order; "w" carries undecoded text, "x" marks left-out raw elements."""
    top = node = Node("#", frozenset(), None)
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "w", page[at : m.start()], node
        at = m.end()
        if m[3] is None:
            continue
        tag, inside = m[3].lower(), m[4] if m[4] is not None else m[5]
        if m[2]:
            up = node
            while up and up.tag != tag:
                up = up.parent
            if up and up is not top:
                node = up.parent
            yield "t", tag, node
            continue
        if tag not in INLINE and tag in ("p", *HEADINGS, "div", "ul", "ol", "table", "section", "article", "footer", "header", "nav", "aside", "form", "blockquote", "pre", "hr", "main", "figure", "dl"):
            up = node
            while up and (up.tag in INLINE or up.tag == "p"):  # a new block ends an open paragraph
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        elif tag in CLOSED_BY and node.tag in CLOSED_BY and CLOSED_BY[node.tag] and tag in CLOSED_BY[node.tag]:
            node = node.parent
        if tag in VOID or inside.rstrip().endswith("/"):
            yield "t", tag, node
            continue
        names = frozenset()
        if "=" in inside:
            names = frozenset(x.lower() for a in _ATTR.finditer(inside) for x in _PART.findall(a[2] or a[3] or a[4] or ""))
        node = Node(tag, names, node)
        yield "t", tag, node
    if at < len(page):
        yield "w", page[at:], node


def _prior(feature: str) -> tuple[float, float]:
    """Words that a feature is thought to have inside and outside articles before any is counted."""
    kind, _, what = feature.partition(" ")
    tag, _, name = what.partition(".")
    if kind == "content":
        return 40.0, 0.5
    if name:
        return (0.5, 10.0) if name in INNER_NAMES or name in OUTER_NAMES else (5.0, 0.5) if name in CONTENT_NAMES else (0.5, 0.5)
    if tag in INNER_TAGS or tag in OUTER_TAGS:
        return 0.5, 10.0
    if kind == "block" and (tag in ("p", "pre", "blockquote") or tag in HEADINGS):
        return 5.0, 1.0
    return 0.5, 0.5


class Weights:
    """Scores of words by the features of where they stand, and of tags."""

    LOW, HIGH, PLAIN, TAG, CONTENT_TAG = -2.0, 1.5, 0.3, -1.5, -0.1
    #: Log-odds are cut to these, for words of one element are no independent witnesses.
    LIMITS = {"block": (-4.0, 4.0), "in": (-5.0, 4.0), "content": (-4.0, 8.0)}

    def __init__(self, words: dict[str, float] | None = None, tags: dict[str, float] | None = None):
        self.words, self.tags = words or {}, tags or {}

    def of(self, feature: str) -> float:
        w = self.words.get(feature)
        if w is None:
            a, b = _prior(feature)
            w = math.log(a / b)
            if len(self.words) < 100_000:
                self.words[feature] = w
        low, high = self.LIMITS[feature.partition(" ")[0]]
        return min(max(w, low), high)

    def word(self, node: Node) -> float:
        if node.content and node.dropped():
            return 0.0  # neither ends the article nor belongs to it
        if node.score is None:
            # of the elements around, the worst and the best count; the block and marked content always
            around = [self.of(f) for f in node.features if f.startswith("in ")]
            own = sum(self.of(f) for f in sorted(node.features) if not f.startswith("in "))
            node.score = min(max(self.PLAIN + own + min(around, default=0.0) * (min(around, default=0.0) < 0) + max(around, default=0.0) * (max(around, default=0.0) > 0), self.LOW), self.HIGH)
        return node.score

    def tag(self, tag: str, node: Node) -> float:
        if node.content:
            return 0.0 if node.dropped() else self.CONTENT_TAG
        return self.tags.get(tag, self.TAG)


def _marked(node: Node) -> bool:
    return any(f"in {t}" in node.features for t in CONTENT_TAGS)


def train(pages: list[str]) -> Weights:
    """Weights from labelled pages: counts inside and outside their marked element."""
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    total: Counter = Counter()
    for page in pages:
        for kind, what, node in items(page or ""):
            inside = _marked(node)
            if kind == "t":
                if what not in CONTENT_TAGS:
                    tags[inside][what] += 1
            elif n := len(what.split()):
                total[inside] += n
                for f in node.features:
                    words[inside][f] += n
    # rates of a feature among the words inside and outside; both kinds of words count alike
    a, b = max(total[True], 1), max(total[False], 1)
    unit = min(a, b)
    w = {}
    for f in words[True].keys() | words[False].keys():
        x, y = _prior(f)
        w[f] = math.log((words[True][f] / a * unit + x) / (words[False][f] / b * unit + y))
    a, b = sum(tags[True].values()) + 1, sum(tags[False].values()) + 1
    t = {}
    for tag in tags[True].keys() | tags[False].keys():
        odds = math.log((tags[False][tag] + 0.5) / b) - math.log((tags[True][tag] + 0.5) / a)
        t[tag] = -min(4.0, max(0.3, 0.8 + odds))
    return Weights(w, t)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the largest sum; (0, 0) if no score is positive."""
    best, where, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, where = run, (start, i + 1)
    return where


def extract(page: str | None, weights: Weights, region=best_region) -> str:
    """Main text of one page."""
    if not page:
        return ""
    seq = list(items(page))
    scores = [weights.tag(x[1], x[2]) if x[0] == "t" else len(x[1].split()) * weights.word(x[2]) for x in seq]
    lo, hi = region(scores)
    blocks: list[list[str]] = [[]]
    for kind, what, node in seq[lo:hi]:
        if kind == "t":
            if what not in INLINE:
                blocks.append([])
            elif what == "br":
                blocks[-1].append(" ")
        elif not node.dropped():
            blocks[-1].append(_html.unescape(what))
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def fitted(pages: DataFrame, most: int = TRAIN_PAGES) -> Weights:
    """Weights from a sample of the pages that mark their article: about ``most``, by a hash of the whole row."""
    marked = pages.select("page_id", "html").filter((F.contains("html", F.lit("<article")) | F.contains("html", F.lit("<main"))) & (F.length("html") <= TRAIN_CHARS))
    marked = marked.withColumn("h", F.xxhash64("page_id", "html"))
    bound = int(min(1.0, most / max(marked.count(), 1)) * (1 << 31))
    rows = marked.filter(F.pmod("h", F.lit(1 << 31)) < bound).dropDuplicates(["h"])  # repeated rows are one
    return train([r["html"] for r in rows.orderBy("h").select("html").collect()])


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = weights or fitted(pages)
    shared = (weights.words, weights.tags)
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        w = Weights(*shared)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [extract(h, w) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(store.read(spark, sf_dir, "pages"))
