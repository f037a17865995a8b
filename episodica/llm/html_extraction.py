"""Main text of web pages by wrapper induction over the pages of a host.

The pages of a host are dealt into groups of some ``GROUP`` pages and ``GROUP_BYTES``, so that a host of any size is many
small tasks; a group is never cut, and holds each different page once.  In
a group the page of middle size is the reference.  Every page's tree of blocks is aligned with the reference's by
simple tree matching, which pairs the largest number of nodes while keeping order and ancestry.  Counted over the
group's different pages, a reference text that the pages share is template, and one that varies is a slot; the wrapper
is the smallest region that holds nearly all varying text and every varying heading beside it.  A page's main text is
what aligns into that region, or stands under a node that does, less the constants.

What varies and still is no content (menus, forms, adverts, comments of readers) cannot be told by votes: elements
that HTML itself declares to be no content go, and elements whose whole class, id or role names such a thing, unless
they hold a heading, an article or half of the page's text.  Where votes leave the region above a lone article that
holds most of the varying text, or where a group is too small to vote, that article is the region.

Trees have one node for each block and one for each run of text in a block; elements within a line are part of the
run.  Equal shapes are one number, equal beginnings and endings of two lists of children are paired at once (which
loses no pair), and the rest is a table in numpy rows, in halves where it is large.

Defined cases: null or empty html gives the empty text; a page without a host, or in a group with fewer than
``LEAST_VOTERS`` different pages, has its region chosen from itself; equal pages have one vote, and pages that share
nearly all text with the reference have none; repeated rows give equal results; trees of any depth and width are
aligned; broken markup is closed as browsers do; nothing is cut.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
UNSEEN = ("script", "style", "noscript")
NO_CONTENT = frozenset("head script style noscript template iframe nav footer aside form button select textarea input svg canvas object dialog menu title option datalist fieldset".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
SCOPES = frozenset("table ul ol dl select article section div".split())
HEADINGS = ("h1", "h2")
#: Words of a class, id or role that name no content wherever they stand in it, and words that do so only alone or
#: beside words of place and shape.
NAMED = frozenset("advert advertisement advertising sponsored sidebar breadcrumb breadcrumbs cookie cookies comments disqus newsletter popup masthead".split())
ALONE = frozenset(
    "ad ads banner sponsor promo menu nav navbar navigation footer header consent notice notification alert modal overlay comment respond discussion reply replies share sharing social related recommended "
    "subscribe subscription signup login search pagination pager contentinfo complementary toolbar skip".split()
)
PLACES = frozenset("site top bottom left right wrapper container box block list section area inner outer slot unit bar link links item items user reader global primary secondary widget form".split())
#: Pages of a group and bytes of its html, about; pages that a vote needs.
GROUP = 128
GROUP_BYTES = 16 << 20
LEAST_VOTERS = 4
#: Share of the varying text that a child must hold to become the region; of the voters that share a constant; of its
#: text that a page may share with the reference and vote; of the page's text that an element named no content may hold.
DESCEND = 0.9
CONSTANT = 0.6
COPY = 0.8
NAMED_MOST = 0.5
#: Cells of a table that is kept whole to read the pairs off it.
CELLS = 1 << 21

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>|\Z", re.I) for t in RAW}
_PART = re.compile(r"[a-z]+")


class Node:
    """A block, or a run of text (``tag`` is empty).  ``content`` is false for what HTML or its name declares none."""

    __slots__ = ("tag", "text", "children", "parent", "at", "content", "named", "shape")

    def __init__(self, tag: str, parent: Node | None, at: int, content: bool, named: bool = False):
        self.tag, self.parent, self.at, self.content, self.named = tag, parent, at, content, named
        self.text = ""
        self.children: list[Node] = []
        self.shape = -1


def parse(source: str) -> list[Node]:
    """The nodes of a page in document order; the first is the root."""
    root = Node("#root", None, 0, True)
    nodes = [root]
    # Open elements from the outside in: name, the block that takes children, whether its text is content.
    stack: list[tuple[str, Node, bool]] = [("#root", root, True)]
    is_open: Counter[str] = Counter()
    run: Node | None = None
    pos, size = 0, len(source)

    def close_to(n: int) -> None:
        nonlocal run
        while len(stack) > n:
            tag, _, _ = stack.pop()
            is_open[tag] -= 1
            if tag not in INLINE:
                run = None

    while pos < size:
        m = _TOKEN.match(source, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[:2] in ("<!", "<?") or not stack[-1][2]:
                continue
            if run is None:
                if text.isspace():
                    continue
                run = Node("", stack[-1][1], len(nodes), True)
                stack[-1][1].children.append(run)
                nodes.append(run)
            run.text += text
            continue
        tag = tag.lower()
        if m[1]:
            if is_open[tag] > 0:
                k = len(stack) - 1
                bounded = tag in CLOSED_BY and tag not in SCOPES and tag != "p"
                while stack[k][0] != tag and not (bounded and stack[k][0] in SCOPES):
                    k -= 1
                if stack[k][0] == tag:
                    close_to(k)
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in SCOPES:
                break
            if tag in CLOSED_BY.get(stack[k][0], ()):
                close_to(k)
                break
        _, block, content = stack[-1]
        attributes = m[3]
        declared = tag in NO_CONTENT or (tag == "header" and not is_open["article"] and not is_open["main"])
        named = hidden = False
        if attributes and tag not in ("html", "body", "article", "main"):
            named, hidden = _named(attributes), "hidden" in attributes.lower() and _HIDDEN.search(attributes) is not None
        if tag in INLINE:
            content = content and not (declared or named or hidden)
            if tag == "br" and run is not None and content:
                run.text += " "
        elif tag not in UNSEEN:
            run = None
            content = content and not (declared or hidden)
            if tag not in RAW:
                block = Node(tag, block, len(nodes), content, named)
                block.parent.children.append(block)
                nodes.append(block)
        if tag in RAW:
            pos = _RAW_END[tag].search(source, pos).end()
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, block, content))
            is_open[tag] += 1
    for n in nodes:
        if not n.tag:
            n.text = clean(n.text)
    _judge_names(nodes)
    return nodes


def _named(attributes: str) -> bool:
    """Whether a whole name among class, id and role names no content."""
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = _PART.findall(name)
            if not NAMED.isdisjoint(parts) or (not ALONE.isdisjoint(parts) and all(p in ALONE or p in PLACES for p in parts)):
                return True
    return False


def _judge_names(nodes: list[Node]) -> None:
    """Blocks named no content are so, with all below them, unless they hold a heading, an article or most text."""
    if not any(n.named for n in nodes):
        return
    mass, holds = [len(n.text) if n.content else 0 for n in nodes], [n.tag in ("h1", "article", "main") for n in nodes]
    for n in reversed(nodes[1:]):
        mass[n.parent.at] += mass[n.at]
        holds[n.parent.at] |= holds[n.at]
    for n in nodes[1:]:
        n.content = n.content and n.parent.content and not (n.named and not holds[n.at] and mass[n.at] <= NAMED_MOST * mass[0])


def clean(text: str) -> str:
    if "&" in text:
        text = entities.unescape(text)
    return " ".join(text.split())


class Shapes:
    """Numbers of equal subtrees, and how many nodes simple tree matching pairs in two of them."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.paired: dict[tuple[int, int], int] = {}

    def name(self, nodes: list[Node]) -> None:
        """Sets the shape of every node, from the leaves up."""
        for n in reversed(nodes):
            key = (n.tag, *[c.shape for c in n.children])
            if key not in self.number:
                self.number[key] = len(self.size)
                self.tag.append(n.tag)
                self.below.append(key[1:])
                self.size.append(1 + sum(self.size[c] for c in key[1:]))
            n.shape = self.number[key]

    def weight(self, a: int, b: int) -> int:
        """Pairs in the largest matching of two subtrees."""
        if a == b:
            return self.size[a]
        if self.tag[a] != self.tag[b]:
            return 0
        if not self.below[a] or not self.below[b]:
            return 1
        if (a, b) not in self.paired:
            x, y, start, end = trimmed(self.below[a], self.below[b])
            equal = sum(self.size[s] for s in self.below[a][:start]) + (sum(self.size[s] for s in self.below[a][-end:]) if end else 0)
            self.paired[a, b] = 1 + equal + (int(self.last_row(x, y)[-1]) if len(x) and len(y) else 0)
        return self.paired[a, b]

    def rows(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[np.ndarray]:
        """Rows of the table of best sums: entry j of row i is for the first i of ``x`` and the first j of ``y``."""
        kinds = {s: k for k, s in enumerate(dict.fromkeys(y))}
        place = np.array([kinds[s] for s in y])
        known: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, np.int64)
        yield row
        for s in x:
            if s not in known:
                known[s] = np.array([self.weight(s, k) for k in kinds])[place]
            new = row.copy()
            np.maximum(new[1:], row[:-1] + known[s], out=new[1:])
            row = np.maximum.accumulate(new)
            yield row

    def last_row(self, x: tuple[int, ...], y: tuple[int, ...]) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int64)
        for row in self.rows(x, y):  # noqa: B007
            pass
        return row

    def pairs(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of two lists of children that the best sum pairs."""
        n, m = len(x), len(y)
        x, y, start, end = trimmed(x, y)
        out = [(k, k) for k in range(start)] + [(n - k, m - k) for k in range(1, end + 1)]
        todo = [(0, len(x), 0, len(y))]
        while todo:
            a, b, c, d = todo.pop()
            if a == b or c == d:
                continue
            if (b - a) * (d - c) <= CELLS or b - a == 1:
                table = list(self.rows(x[a:b], y[c:d]))
                i, j = b - a, d - c
                while i and j:
                    if table[i][j] == table[i - 1][j]:
                        i -= 1
                    elif table[i][j] == table[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        if self.tag[x[a + i]] == self.tag[y[c + j]]:
                            out.append((start + a + i, start + c + j))
                continue
            # Too large to keep: the best cut of y for the two halves of x needs one row from either end.
            middle = (a + b) // 2
            ahead, back = self.last_row(x[a:middle], y[c:d]), self.last_row(x[middle:b][::-1], y[c:d][::-1])[::-1]
            cut = c + int(np.argmax(ahead + back))
            todo += [(a, middle, c, cut), (middle, b, cut, d)]
        return out


def trimmed(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
    """What is between the equal beginning and the equal ending of two lists, and the lengths of these."""
    most, start, end = min(len(x), len(y)), 0, 0
    while start < most and x[start] == y[start]:
        start += 1
    while end < most - start and x[-1 - end] == y[-1 - end]:
        end += 1
    return x[start : len(x) - end], y[start : len(y) - end], start, end


def align(a: Node, b: Node, shapes: Shapes) -> dict[int, int]:
    """Simple tree matching of two named trees with equal roots: node of ``a`` -> node of ``b``."""
    out, todo = {}, [(a, b)]
    while todo:
        x, y = todo.pop()
        out[x.at] = y.at
        if x.shape == y.shape:
            todo += zip(x.children, y.children, strict=True)
        elif x.children and y.children:
            todo += [(x.children[i], y.children[j]) for i, j in shapes.pairs(shapes.below[x.shape], shapes.below[y.shape])]
    return out


def runs(nodes: list[Node]) -> list[Node]:
    """The texts of a page that are not declared or named no content."""
    return [n for n in nodes if not n.tag and n.text and n.content]


def votes(page: list[Node], pairs: dict[int, int], reference: list[Node]) -> tuple[set[int], dict[int, int], float]:
    """Reference texts that the page shares, characters that vary at or under each reference node, share of nearly equal text."""
    equal: set[int] = set()
    varying: Counter[int] = Counter()
    same = whole = 0
    for n in runs(page):
        whole += len(n.text)
        x = n
        while x.at not in pairs:
            x = x.parent
        other = reference[pairs[x.at]]
        if x is n and other.text == n.text:
            equal.add(other.at)
            same += len(n.text)
        else:
            varying[other.at] += len(n.text)
            mine, its = set(n.text.split()), set(other.text.split())
            if len(mine & its) > COPY * max(len(mine), len(its)):
                same += len(n.text)
    return equal, varying, same / max(whole, sum(len(n.text) for n in runs(reference)), 1)


def lone_article(nodes: list[Node]) -> Node | None:
    """The page's one outermost article, or else its one outermost main element."""
    for tag in ("article", "main"):
        found = []
        for n in nodes:
            if n.tag == tag and n.content:
                x = n.parent
                while x is not None and x.tag != tag:
                    x = x.parent
                if x is None:
                    found.append(n)
        if len(found) == 1:
            return found[0]
    return None


def region_of(nodes: list[Node], varying: dict[int, int], voted: bool) -> int:
    """The node that holds the varying text: down from the root as long as one child has nearly all of it."""
    mass, heading = [varying.get(n.at, 0) for n in nodes], [False] * len(nodes)
    for n in reversed(nodes[1:]):
        heading[n.at] |= n.tag in HEADINGS and mass[n.at] > 0
        heading[n.parent.at] |= heading[n.at]
        mass[n.parent.at] += mass[n.at]
    article = lone_article(nodes)
    if article is not None and not voted:
        return article.at
    here = nodes[0]
    while True:
        below = [c for c in here.children if c.content and any(x.tag for x in c.children)]
        best = max(below, key=lambda c: mass[c.at], default=None)
        if best is None or mass[best.at] < DESCEND * mass[here.at] or any(heading[c.at] for c in here.children if c is not best):
            break
        here = best
    if article is not None and mass[article.at] * 2 >= mass[here.at]:
        x: Node | None = article
        while x is not None and x is not here:
            x = x.parent
        if x is here:
            return article.at
    return here.at


def main_text(page: list[Node], pairs: dict[int, int] | None, region: int, constants: frozenset[int], reference: list[Node]) -> str:
    """Blocks of the page that align into the region, or stand under what does; ``pairs`` is None for the page itself."""
    inside = [False] * len(reference)
    for n in reference[region:]:
        inside[n.at] = n.at == region or (n.parent is not None and inside[n.parent.at])
    kept, out = [False] * len(page), []
    for n in page:
        at = pairs.get(n.at) if pairs is not None else n.at
        kept[n.at] = inside[at] if at is not None else n.parent is not None and kept[n.parent.at]
        if not n.tag and n.text and n.content and kept[n.at] and not (at in constants and reference[at].text == n.text):
            out.append(n.text)
    return "\n".join(out)


def _alone(page: list[Node]) -> str:
    return main_text(page, None, region_of(page, {n.at: len(n.text) for n in runs(page)}, False), frozenset(), page)


@contextmanager
def _deep() -> Iterator[None]:
    """Matching calls itself as deep as trees are; such calls take no native stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000_000)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def texts_of_group(sources: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    order = sorted({s for s in sources if s})
    pages = [parse(s) for s in order]
    if len(pages) < LEAST_VOTERS:
        found = [_alone(p) for p in pages]
    else:
        shapes = Shapes()
        for p in pages:
            shapes.name(p)
        reference = sorted(pages, key=len)[len(pages) // 2]
        with _deep():
            aligned = [align(p[0], reference[0], shapes) for p in pages]
        found = _wrapped(pages, aligned, reference)
    by_source = dict(zip(order, found, strict=True))
    return [by_source.get(s, "") for s in sources]


def _wrapped(pages: list[list[Node]], aligned: list[dict[int, int]], reference: list[Node]) -> list[str]:
    equals: Counter[int] = Counter()
    varying: Counter[int] = Counter()
    voters = 0
    for p, pairs in zip(pages, aligned, strict=True):
        if p is not reference:
            equal, varies, share = votes(p, pairs, reference)
            if share <= COPY:
                voters += 1
                equals.update(equal)
                varying.update(varies)
    if voters < LEAST_VOTERS - 1:
        return [_alone(p) for p in pages]
    constants = frozenset(at for at, n in equals.items() if n >= CONSTANT * voters)
    varying.update({n.at: len(n.text) for n in runs(reference) if n.at not in constants})
    region = region_of(reference, {at: n for at, n in varying.items() if at not in constants}, True)
    return [main_text(p, pairs, region, constants, reference) or _alone(p) for p, pairs in zip(pages, aligned, strict=True)]


def host_of(url: Column) -> Column:
    """Host of an address, in lower case without port; null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(found, F.lit(""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, salt, html, kept columns, with groups one after another -> kept columns, text."""
    name, sources, kept, known = None, [], [], {}

    def out() -> pa.RecordBatch:
        texts = texts_of_group(sources) if name[0] is not None else [texts_of_group([s])[0] for s in sources]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(kept), pa.array(texts, pa.string())], names=["_kept", "main_text"])

    for batch in batches:
        hosts, salts, htmls = (batch.column(k).to_pylist() for k in range(3))
        start = 0
        for k in range(batch.num_rows):
            group = (hosts[k], salts[k])
            if name is not None and group != name:
                if k > start:
                    kept.append(batch.column(3).slice(start, k - start))
                if kept:
                    yield out()
                start, sources, kept, known = k, [], [], {}
            name = group
            sources.append(known.setdefault(htmls[k] or "", htmls[k] or ""))
        kept.append(batch.column(3).slice(start))
    if kept:
        yield out()


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of every page with ``main_text``."""
    given = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"), F.struct(*keep).alias("_kept"))
    # Hosts of more than one group: at most one row for GROUP pages, joined by broadcast only while the file is small.
    sized = given.where("host is not null").groupBy(F.col("host").alias("large")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    # Of very large pages a group still gets some four times the voters that it needs.
    by_bytes = F.least(F.ceil(F.coalesce("bytes", F.lit(0)) / GROUP_BYTES), F.ceil(F.col("n") / (4 * LEAST_VOTERS)))
    sized = sized.select("large", F.greatest(F.ceil(F.col("n") / GROUP), by_bytes).alias("parts"))
    parts = durable(sized.where("parts > 1"), "hosts")
    dealt = F.xxhash64("html", "_kept")
    salt = F.when(F.col("host").isNull(), F.pmod(dealt, F.lit(1 << 20))).otherwise(F.pmod(dealt, F.coalesce("parts", F.lit(1).cast("long"))))
    salted = given.join(parts, F.col("host") == F.col("large"), "left").select("host", salt.alias("salt"), "html", "_kept")
    schema = given.select("_kept", F.lit("").alias("main_text")).schema
    (name,) = fresh(pages.select(*keep), "main_text")
    grouped = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", F.xxhash64("html"))
    return grouped.mapInArrow(_extract, schema).select("_kept.*", F.col("main_text").alias(name))
