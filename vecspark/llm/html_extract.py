"""Main text of pages by wrapper induction.

Pages of a host are read in blocks of `block` pages or `block_bytes`, in page order. In
a block the pages' DOM trees are aligned with that of a reference page, one of the most
common outline, by simple tree matching: two nodes match only if tag and class agree,
and the children of matched nodes are aligned, in order, so that the matched nodes are
as many as can be. The aligned nodes are slots, and what the pages hold in them decides:

- a slot that holds the same text in nearly all pages is template;
- of the other slots, the text outside links is counted over all pages. From the root
  the induction goes down as long as one child holds nearly all of that text; the node
  where it stops is the article, and all beside the way (menus, whose text is links,
  adverts and footers, whose varying text is short) is none of it.

What elements, class words and roles say only weighs the counts (`names`): a menu,
footer, advert or comment counts a tenth, an article or main element double. Inside the
article elements that hold no article text by what HTML says about them are left out,
and those whose class words all name something else. Pages that share most of their text
(copies of one article) count as one page, so that a group of copies does not make its
own article a template. A page that aligns with no article, or stands with too few
others, is judged by itself: by names, and by its counts only between landmarks. A short last block borrows pages of the one before.

Pages meet by a shuffle on (host, part). A host with more than a thousandth of all
pages (there are at most a thousand of those, which bounds the broadcast) is dealt by
a hash into parts; a part is read in page order as a stream, so memory holds a block
of pages whatever the host.

Defined cases: null or empty html gives the empty text; a null url has the empty host;
repeated rows are pages like any other; a malformed or cut-off page is read as far as
it goes; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._shared import pieces

RESULT = "page_id long, url string, text string, n_chars long"


@dataclass(frozen=True)
class WrapperParams:
    """`constant`: share of a block's different pages that a template text is in; `share`: of the text, that the way to the article holds."""

    block: int = 64
    block_bytes: int = 8_000_000
    constant: float = 0.8
    share: float = 0.8
    least_pages: int = 4
    alike: float = 0.5
    hot_share: int = 1000
    names: bool = True


#: What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|canvas|object|audio|video|select|title"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "dd", "dt", "li"} | {"dd", "dt", "li"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements, class words and roles that hold no article text.
DROPPED = frozenset("head nav footer aside form button menu dialog search label fieldset input datalist optgroup option".split())
DROPPED_WORDS = frozenset("nav navbar navigation menu sidebar footer header masthead banner breadcrumb breadcrumbs cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup ad ads adv advert adverts advertisement sponsor sponsored promo promotion social share sharing related recommended comment comments disqus replies reply respond pagination pager toolbar widget login searchbox skip copyright".split())
#: Words that say nothing beside one of those.
FILLER = frozenset("area bar block box btn button container content head inline inner item items left link links list outer panel right row section slot small text title top bottom unit wrap wrapper".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """An element: key (tag and class), children in order (elements and text), its number, subtree shape and characters."""

    __slots__ = ("children", "dropped", "key", "number", "plain", "shape", "size", "tag")

    def __init__(self, tag: str, key: str, dropped: bool):
        self.tag, self.key, self.dropped = tag, key, dropped
        self.children: list = []
        self.number = self.shape = self.size = self.plain = 0

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is Node]


def named_other(names: str) -> bool:
    """Whether one of the class names says, word for word, that this is no article text.

    "notice-period" does not, as "period" is no such word.
    """
    for name in names.split():
        words = set(_WORD.findall(name.lower()))
        rest = {w for w in words - DROPPED_WORDS - FILLER if not w.isdigit()}
        if words & DROPPED_WORDS and not rest:
            return True
    return False


def _start(tag: str, attrs: str, names: bool) -> Node:
    if not attrs.strip(" /"):
        return Node(tag, tag, names and tag in DROPPED)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    other = tag in DROPPED or found.get("role", "").lower() in DROPPED_ROLES or tag not in ("html", "body", "main") and named_other(f"{found.get('class', '')} {found.get('id', '')}")
    return Node(tag, f"{tag}.{found.get('class', '')}", hidden or names and other)


def parse(html: str, names: bool = True) -> Node:
    """The page's tree, with the omitted end tags that HTML allows."""
    root = Node("#", "#", False)
    stack, at = [root], 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        tag = name.lower()
        if m[2]:
            if tag == "br":
                stack[-1].children.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table", "caption", "button", "object"):
                    break
        if tag in SIBLINGS:
            ends, scope = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in scope:
                    break
        node = _start(tag, m[4], names)
        stack[-1].children.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
    if at < len(html):  # a tag that the page's end cuts off is none of its text
        stack[-1].children.append(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", html[at:]))
    return root


class Shapes:
    """Numbers for subtree shapes: equal numbers, equal trees of keys. Also memory of matched sizes."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}
        self.nodes: dict[int, Node] = {}

    def label(self, root: Node) -> list[Node]:
        """Nodes in document order, numbered, with shape and size."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            node.number = len(order)
            order.append(node)
            stack += reversed(node.elements())
        for node in reversed(order):
            kids = node.elements()
            node.size = 1 + sum(k.size for k in kids)
            node.shape = self.numbers.setdefault((node.key, *(k.shape for k in kids)), len(self.numbers))
            self.nodes.setdefault(node.shape, node)
        return order

    def matched(self, a: Node, b: Node) -> int:
        """Nodes that simple tree matching pairs in two subtrees; pairs wait on a stack of their own, so depth has no limit."""
        known = self._known(a, b)
        if known is not None:
            return known
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if self._known(x, y) is not None:
                stack.pop()
                continue
            _, left, right = self._middle(x, y)
            some = {c.shape: c for c in right}.values()
            need = [(c, d) for c in {c.shape: c for c in left}.values() for d in some if self._known(c, d) is None]
            if need:
                stack += need
            else:
                self.sizes[self._pair(x, y)] = 1 + sum(self._known(c, d) for c, d in self.children(x, y))
                stack.pop()
        return self._known(a, b)

    @staticmethod
    def _pair(a: Node, b: Node) -> tuple[int, int]:
        return (a.shape, b.shape) if a.shape < b.shape else (b.shape, a.shape)

    def _known(self, a: Node, b: Node) -> int | None:
        if a.key != b.key:
            return 0
        return a.size if a.shape == b.shape else self.sizes.get(self._pair(a, b))

    @staticmethod
    def _middle(a: Node, b: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
        """Children that are equal from either end, paired, and those between: pairing equal ends is never worse."""
        x, y = a.elements(), b.elements()
        n, out = min(len(x), len(y)), []
        i = 0
        while i < n and x[i].shape == y[i].shape:
            out.append((x[i], y[i]))
            i += 1
        j = 0
        while j < n - i and x[-1 - j].shape == y[-1 - j].shape:
            out.append((x[-1 - j], y[-1 - j]))
            j += 1
        return out, x[i : len(x) - j], y[i : len(y) - j]

    def children(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The best alignment, in order, of the children of two nodes; the middle is filled in row by row."""
        out, x, y = self._middle(a, b)
        if not x or not y:
            return out
        kinds: dict[int, int] = {}
        of_y = np.array([kinds.setdefault(c.shape, len(kinds)) for c in y])
        kind_nodes = [self.nodes[s] for s in kinds]
        rows = [np.zeros(len(y) + 1, np.int64)]
        weights: dict[int, np.ndarray] = {}
        for c in x:
            w = weights.get(c.shape)
            if w is None:
                w = weights[c.shape] = np.array([self.matched(c, k) for k in kind_nodes], np.int64)[of_y]
            row = rows[-1].copy()
            np.maximum(row[1:], rows[-1][:-1] + w, out=row[1:])
            rows.append(np.maximum.accumulate(row))
        i, j = len(x), len(y)
        while i and j:
            here = rows[i][j]
            if here == rows[i - 1][j]:
                i -= 1
            elif here == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
        return out

    def align(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """All node pairs that simple tree matching makes of two trees."""
        out, stack = [], [(a, b)]
        while stack:
            x, y = stack.pop()
            if x.key == y.key:
                out.append((x, y))
                stack += zip(x.elements(), y.elements()) if x.shape == y.shape else self.children(x, y)
        return out


def own_text(node: Node) -> str:
    """The text that stands directly in a node, and in its inline elements."""
    parts, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.__class__ is str:
            parts.append(n)
        elif n is node or n.tag not in BLOCKS:
            stack += reversed(n.children)
    return " ".join(_html.unescape("".join(parts)).split())


def blocks(top: Node, template: set[int], landmark: bool) -> list[str]:
    """Text blocks under `top` in page order, without template nodes; outside a landmark, without blocks that are mostly links."""
    out: list[str] = []
    line: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(line)
        text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
        if text and (landmark or 2 * linked < len(raw)):
            out.append(text)
        line.clear()
        linked = 0

    # Items: a child to visit, with whether links hold it and a header does; None ends a block.
    stack: list = [(top, False, False)]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
            continue
        node, link, header = item
        if node.__class__ is str:
            if not header:
                line.append(node)
                linked += len(node) * link
            continue
        tag = node.tag
        if node is not top and node.dropped or node.number in template:
            if tag in BLOCKS:
                flush()
            elif not header:
                line.append(" ")
            continue
        if tag == "header":  # of a header, an article's own headings stay
            header = True
        elif header and landmark and heading(node):
            header = False
        if tag in BLOCKS:
            flush()
            stack.append(None)
        elif tag in ("br", "td", "th"):
            line.append(" ")
        link = link or tag == "a"
        stack += [(c, link, header) for c in reversed(node.children)]
    flush()
    return out


def count_text(order: list[Node], template: set[int]) -> None:
    """Set `plain` of each node of a page: characters under it outside links and template nodes."""
    for node in reversed(order):
        if node.tag == "a" or node.number in template:
            node.plain = 0
        else:
            node.plain = sum(len(c.strip()) if c.__class__ is str else c.plain for c in node.children)


def holds_blocks(node: Node) -> bool:
    return any(c.tag in BLOCKS for c in node.elements())


def heading(node: Node) -> bool:
    return len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1].isdigit()


def way(root: Node, text: Callable[[Node], float], wide: Callable[[Node], bool], p: WrapperParams, share: float, other: float) -> list[Node]:
    """The nodes from the root down to the article.

    text: of a slot; wide: whether it holds blocks. A child goes on the way if it has
    `share` of its siblings' text, where those named something else count `other` times,
    and an article or main element double. The way ends at an article element, and where
    a heading stands beside a child that is no landmark.
    """
    path = [root]
    while not (p.names and path[-1].tag == "article"):
        kids = path[-1].elements()
        if not kids:
            break
        is_mark = [p.names and not k.dropped and k.tag in ("article", "main") for k in kids]
        parts = [text(k) * (other if k.dropped else 2 if mark else 1) for k, mark in zip(kids, is_mark)]
        loose = max(0.0, text(path[-1]) - sum(map(text, kids)))
        best = int(np.argmax(parts))
        least = min(share, p.share) if is_mark[best] else share
        if not parts[best] or parts[best] < least * (sum(parts) + loose) or not wide(kids[best]):
            break
        if not is_mark[best] and any(heading(k) and x for k, x in zip(kids, parts)):
            break
        path.append(kids[best])
    return path


def landmark(path: list[Node], p: WrapperParams) -> bool:
    return not p.names or any(n.tag in ("article", "main") for n in path)


def alone(root: Node, p: WrapperParams) -> list[str]:
    """The blocks of a page judged by itself."""
    path = way(root, lambda n: n.plain, lambda n: True, p, 1.0, 0.0)
    return blocks(path[-1], set(), landmark(path, p))


def families(texts: list[frozenset[str]], alike: float) -> list[int]:
    """Pages that stand for all that share most of their text with them."""
    chosen: list[int] = []
    for i, t in enumerate(texts):
        if not any(len(t & texts[j]) > alike * min(len(t), len(texts[j])) for j in chosen) and t:
            chosen.append(i)
    return chosen


def outline(root: Node, depth: int = 3) -> tuple:
    """The keys of a page's upper elements."""
    out, level = [], root.elements()
    for _ in range(depth):
        out.append(tuple(n.key for n in level))
        level = [c for n in level for c in n.elements()]
    return tuple(out)


def stray(root: Node, top: Node, aligned: set[int]) -> int:
    """Characters outside `top` under nodes that align with nothing."""
    total, stack = 0, [root]
    while stack:
        node = stack.pop()
        if node.number not in aligned:
            total += node.plain
        elif node is not top:
            stack += node.elements()
    return total


def extract_block(pages: list[str], p: WrapperParams, others: list[str] | None = None) -> list[str]:
    """Main texts of pages of one host; `others` only help to tell what the host's template is."""
    shapes = Shapes()
    roots = [parse(h, p.names) for h in [*pages, *(others or ())]]
    orders = [shapes.label(r) for r in roots]
    for order in orders:
        count_text(order, set())
    found = [alone(r, p) for r in roots]
    different = families([frozenset(b) for b in found], p.alike)
    if len(different) >= p.least_pages:
        common = Counter(outline(roots[i]) for i in different)
        ref = max(different, key=lambda i: (common[outline(roots[i])], -i))
        pairs = {i: shapes.align(roots[ref], root) for i, root in enumerate(roots)}
        slots = [0] * len(orders[ref])
        texts: dict[int, str] = {}
        for i in different:
            for x, y in pairs[i]:
                if y.children and x.number not in texts:
                    texts[x.number] = own_text(x)
                if texts.get(x.number):
                    slots[x.number] += texts[x.number] == own_text(y)
        template = {n for n, k in enumerate(slots) if k >= p.constant * len(different) and texts.get(n)}
        gone = [{y.number for x, y in pairs[i] if x.number in template and not holds_blocks(y) and own_text(y) == texts[x.number]} for i in range(len(roots))]
        for order, some in zip(orders, gone):
            count_text(order, some)
        mass, wide = np.zeros(len(slots)), np.zeros(len(slots))
        for i in different:
            for x, y in pairs[i]:
                mass[x.number] += y.plain
                wide[x.number] += 1 if holds_blocks(y) else -1
        path = way(roots[ref], lambda n: mass[n.number], lambda n: wide[n.number] > 0, p, p.share, 0.1)
        for i in range(len(pages)):
            top = next((y for x, y in pairs[i] if x is path[-1]), None)
            # A page with more text where nothing aligns has another layout.
            if top is not None and top.plain >= stray(roots[i], top, {y.number for _, y in pairs[i]}):
                found[i] = blocks(top, gone[i], landmark(path, p))
    return ["\n\n".join(b) for b in found[: len(pages)]]


def extract(pages: DataFrame, params: WrapperParams | None = None) -> DataFrame:
    """RESULT columns for every page."""
    p = params or WrapperParams()
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    most = max(p.block, -(-total // p.hot_share))
    hot = counts.filter(F.col("n") > most).select(F.col("host").alias("h"), F.ceil(F.col("n") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    dealt = rows.join(F.broadcast(hot), rows["host"] == hot["h"], "left").withColumn("part", part)
    ordered = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url").select("host", "part", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, ids, urls, pages_, before = None, 0, [], [], [], []

        def done() -> pa.RecordBatch:
            texts = extract_block(pages_, p, before if 2 * len(pages_) < p.block else None)
            columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            return pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

        for batch in (x for b in batches for x in pieces(b)):
            for host_, part_, page, url, html in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if ids and ((host_, part_) != key or len(ids) == p.block or size + len(html) > p.block_bytes):
                    yield done()
                    before = [h for h in pages_[-4 * p.least_pages :] if len(h) < p.block_bytes // 64] if (host_, part_) == key else []
                    size, ids, urls, pages_ = 0, [], [], []
                key = (host_, part_)
                size += len(html)
                ids.append(page)
                urls.append(url)
                pages_.append(html)
        if ids:
            yield done()

    return ordered.mapInArrow(run, RESULT)
