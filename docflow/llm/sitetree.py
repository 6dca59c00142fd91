"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. Its nodes are branches of elements: a branch
is known by the labels on its way from the body, where neighbours of one label count as one.
Two entropies say how much a branch matters to its host:

* presentation: pages that lay out the branch (the labels of its children) in many ways
  speak for content, one layout everywhere for a template;
* content: a text found evenly on all pages of the branch (entropy 1, base: its pages)
  is boilerplate, one that a single page has (entropy 0) is content.

The importance of a branch is ``(1 - 0.9^l) * presentation + 0.9^l * content``, l being its
mean number of children, as the deeper importance is felt less through many children. Branches of
low importance are cut off each page. The markup's own words come first: what is named as
navigation, advert, form and the like has no importance, what is named as the article
or stands in it as plain paragraphs has all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import saved
from docflow.session import spread

#: Branches of a host that fewer pages have, each with another html, are left as they are.
LEAST_PAGES = 8
#: Branches of lower importance are cut off.
LEAST_IMPORTANCE = 0.2
#: How fast the importance of what is inside fades with the number of children.
FADING = 0.9
#: Deeper branches count as part of their ancestor at this depth.
DEEPEST = 24

# Element names of the markup standard by what they are.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NOISE = frozenset("nav footer aside form menu dialog search select button label fieldset legend".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption summary".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# a start tag of the first kind ends an open element of the second
_ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tr", "td", "th"),
    "body": ("head",),
}
_HOLDERS = frozenset("ul ol dl table menu".split())
#: Words of class and id that name what is not the article.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo related replies respond share sharing sidebar sitenav skip "
    "social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Of these, the words that also condemn an inline element, which may stand in a sentence.
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored".split())
#: A class with ``header`` and one of these is the head of an article, not of a page.
ARTICLE_WORDS = frozenset("article post entry story content title".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Node:
    """An element: its place in the tree, children's labels, and what its markup calls it."""

    __slots__ = (
        "parent", "tag", "noise", "head", "is_main", "holds_main", "in_main", "kinds", "path",
        "depth", "size", "out",
    )

    def __init__(self, parent: Node | None, tag: str, label: str, noise: bool, head: bool, main: bool):
        self.parent, self.tag, self.noise, self.head, self.is_main = parent, tag, noise, head, main
        self.holds_main, self.in_main, self.kinds, self.path = main, main, [], 0
        self.depth, self.size, self.out = 0, 0, False
        if parent is None:
            return
        if not parent.kinds or parent.kinds[-1] != label:
            parent.kinds.append(label)
        self.in_main |= parent.in_main
        self.depth = parent.depth + 1
        self.path = parent.path
        if self.depth <= DEEPEST:
            place = f"{parent.path}/{label}"
            self.path = xxhash.xxh3_64_intdigest(place) - (1 << 63)

    @property
    def judged(self) -> bool:
        """Whether the entropies may cut this branch: no paragraph, nothing around a main element."""
        return not (
            self.holds_main
            or self.depth > DEEPEST
            or self.tag in _PARAGRAPHS
            or self.tag in ("html", "body", "")
        )


Block = tuple[Node, str]


def _labelled(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(label, named as noise, as a head, as main content) of a start tag."""
    noise, head, main, names = tag in _NOISE, tag == "header", tag in ("main", "article"), []
    condemning = NOISE_WORDS if tag in _BLOCKS else INLINE_WORDS
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = unescape(values[0] or values[1] or values[2])
            if name.lower() == "role":
                noise |= value.strip().lower() in _NOISE_ROLES
                main |= value.strip().lower() in ("main", "article")
            else:
                words = {w.lower() for w in _NAME_PARTS.findall(value)}
                named = not condemning.isdisjoint(words)
                noise |= named
                # a comment may be marked up as an article of its own
                main &= not named
                head |= "header" in words and ARTICLE_WORDS.isdisjoint(words)
                if name.lower() == "class":
                    names = sorted(set(value.split()))
    return ".".join([tag, *names]), noise and not main and tag not in ("html", "body"), head, main


def parsed(html: str) -> tuple[list[Node], list[Block]]:
    """(elements, parents first; text blocks in page order, each with its element).

    A tolerant reading: unclosed paragraphs, list items and inline elements end
    where the next block begins, end tags without a start are ignored, unclosed
    comments and scripts reach to the end.
    """
    here = Node(None, "", "", False, False, False)
    nodes, blocks, held = [here], [], []
    open_noise: list[str] = []  # inline elements named as noise

    def end_block() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                blocks.append((here, text))
            held.clear()

    def closed(tags: tuple[str, ...], walls: frozenset) -> Node | None:
        at = here
        while at.parent is not None and at.tag not in walls:
            if at.tag in tags:
                return at.parent
            at = at.parent
        return None

    at = 0
    for_text = len(html)
    while at < for_text:
        found = _TOKEN.search(html, at)
        start = found.start() if found else for_text
        if start > at and not open_noise:
            held.append(html[at:start])
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in _BLOCKS:
                end_block()
                open_noise.clear()
                opened = closed((tag,), frozenset())
                here = opened or here
            elif open_noise and tag == open_noise[-1]:
                open_noise.pop()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in _RAW:
            if not found[3].endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else for_text
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        label, noise, head, main = _labelled(tag, found[3])
        if tag not in _BLOCKS:
            # inline elements do not shape the tree; those named as noise are skipped
            if noise or open_noise and tag == open_noise[-1]:
                open_noise.append(tag)
            continue
        end_block()
        open_noise.clear()
        if tag == "hr":
            continue
        outer = closed(_ENDS[tag], _HOLDERS - {tag}) if tag in _ENDS else None
        if outer is None and here.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            outer = here.parent
        here = Node(outer or here, tag, label, noise, head, main)
        nodes.append(here)
        if main:
            above = here.parent
            while above is not None and not above.holds_main:
                above.holds_main = True
                above = above.parent
    end_block()
    return nodes, blocks


def _sized(nodes: list[Node], blocks: list[Block]) -> int:
    """Give each element the length of the blocks inside it; return that of all."""
    for node in nodes:
        node.size = 0
    for node, text in blocks:
        node.size += len(text)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
    return nodes[0].size


def main_blocks(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """What the markup's own words leave: the blocks of the main elements, without
    elements named as noise. A page's header counts as noise, an article's does not.

    Without a main element all blocks are candidates; an element that holds more than
    half of their text is then no noise but a wrapper, unless it is navigation or a footer.
    """
    total = _sized(nodes, blocks)

    def left(wrappers: bool) -> list[Block]:
        for node in nodes:
            node.out = node.parent is not None and node.parent.out
            if node.holds_main:
                node.out = False
            elif node.noise or node.head and not node.in_main:
                wraps = wrappers and 2 * node.size > total and node.tag not in ("nav", "footer")
                node.out |= not wraps
        return [(n, t) for n, t in blocks if not n.out]

    inside = [(n, t) for n, t in left(False) if n.in_main]
    return inside or left(True)


def kept_text(html: str, cut: frozenset[int]) -> str:
    """The page's main text without the branches in ``cut``.

    A branch that holds more than half of the page's main text stays: boilerplate is
    the smaller part of a page, and no page is emptied for being like others.
    """
    nodes, blocks = parsed(html)
    blocks = main_blocks(nodes, blocks)
    if cut:
        total = _sized(nodes, blocks)
        for node in nodes:
            node.out = node.parent is not None and node.parent.out
            node.out |= node.judged and node.path in cut and 2 * node.size <= total
        blocks = [(n, t) for n, t in blocks if not n.out]
    return "\n\n".join(t for _, t in blocks)


def _judged_branches(node: Node, first: dict[int, Node]) -> Iterator[Node]:
    """The branches around a block that may be cut, inner ones first."""
    node = first.get(id(node), node)
    while node.parent is not None:
        if node.judged:
            yield node
        node = node.parent


def host(url: Column) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


_FEATURES = "host string, page long, branch long, style long, children int, texts array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and branch of the style tree: layout, children and texts, as hashes."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows: list[tuple] = []
        for site, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            page = digest(html) - (1 << 63)
            found: dict[int, tuple[str, int, set[int]]] = {}
            nodes, blocks = parsed(html)
            shallow: dict[int, Node] = {}
            for node in nodes:
                if node.depth > DEEPEST:
                    shallow[id(node)] = shallow.get(id(node.parent), node.parent)
            for node, text in main_blocks(nodes, blocks):
                feature = digest(text) - (1 << 63)
                for branch in _judged_branches(node, shallow):
                    if branch.path not in found:
                        found[branch.path] = (" ".join(branch.kinds), len(branch.kinds), set())
                    found[branch.path][2].add(feature)
            rows += [
                (site, page, path, digest(style) - (1 << 63), n, sorted(texts))
                for path, (style, n, texts) in found.items()
            ]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        names = [c.split()[0] for c in _FEATURES.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
        )


def branch_importance(pages: DataFrame) -> DataFrame:
    """(host, branch, pages, importance) of the branches that several pages of a host share.

    ``pages`` has host and html. Pages of one host with the same html count once. All
    entropies are sums over counts that are combined in the tasks before they are
    shuffled: no host has to fit in a task.
    """
    found = saved(pages.mapInArrow(_features, _FEATURES), "site-branches")
    one = found.groupBy("host", "branch", "page").agg(
        F.min("style").alias("style"), F.min("children").alias("children")
    )
    layouts = one.groupBy("host", "branch", "style").agg(
        F.count(F.lit(1)).alias("n"), F.sum("children").alias("children")
    )
    n = F.col("n").cast("double")
    shape = layouts.groupBy("host", "branch").agg(
        F.sum("n").alias("pages"),
        F.sum(n * F.log(n)).alias("s"),
        F.sum("children").alias("children"),
    ).where(F.col("pages") >= LEAST_PAGES)
    # a text is on a page or not, so its entropy over its c pages is log c
    texts = (
        found.select("host", "branch", "page", F.explode("texts").alias("text"))
        .distinct()
        .groupBy("host", "branch", "text")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("host", "branch")
        .agg(F.avg(F.log("n")).alias("evenness"))
    )
    m = F.col("pages").cast("double")
    presentation = (F.log(m) - F.col("s") / m) / F.log(m)
    content = 1 - F.col("evenness") / F.log(m)
    fading = F.pow(F.lit(FADING), F.col("children") / m)
    return shape.join(texts, ["host", "branch"]).select(
        "host",
        "branch",
        "pages",
        ((1 - fading) * presentation + fading * content).alias("importance"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Other columns are ignored, whatever their names. A null or empty html has an empty text;
    pages without a host are judged together as one. Repeated rows give repeated results
    and count once in the tree. An empty table has no result rows. Long pages are
    taken whole: one page is in memory at a time.
    """
    sites = pages.select(
        "page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")
    )
    judged = branch_importance(sites.select("host", "html"))
    low = judged.where(F.col("importance") < LEAST_IMPORTANCE)
    cuts = saved(low.groupBy("host").agg(F.collect_set("branch").alias("cut")), "site-cuts")
    schema = sites.select("page_id", "url").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                kept_text(html, frozenset(cut or ()))
                for html, cut in zip(batch["html"].to_pylist(), batch["cut"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    together = sites.join(spread(cuts), "host", "left").select("page_id", "url", "html", "cut")
    return together.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
