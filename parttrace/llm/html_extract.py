"""HTML extraction: minimum-cut labelling of a page's text blocks.

A page is cut into blocks at block-level tags. A classifier gives each block its cost, the log odds of being content: a
logistic regression over the block's own looks (length, share of links, sentence end, kind of tag, place in the page),
within ``OWN``, and evidence of its ancestors' tags, class names, ids and roles, within ``PATH``. The costs are the
capacities of the block's edges to the two terminals. Blocks that follow each other and like blocks of one parent are
joined by smoothness edges, the weaker the farther apart they are in the tree and weaker yet at a named container.
The minimum cut, found by maximum flow, separates content from boilerplate: a short line between paragraphs goes with
them, a paragraph between adverts doesn't. Blocks whose terminal outweighs all their other edges are settled before the
flow, which leaves the cut minimal.

The regression is fitted on blocks of ``SAMPLE`` pages (those with the least hashes; its only input from them are their
own looks) whose page says itself what they are: those within article or main against those within nav, footer, aside,
header or form. Without both kinds it keeps ``START``.

The text of a block has its character references decoded and white space turned into single spaces; content blocks are
joined by \\n in page order. Scripts, styles, comments in the markup, form controls and titles are never blocks. Null or
empty pages give an empty text; unclosed tags are closed by what follows them, and quotes that are never closed end with
their tag. Repeated rows give equal texts; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A tag's end: after attributes whose quoted values hold no "<"; else with such values; else at the next ">".
_END = (
    r"(?>[^<>\"']+|\"[^\"<]*\"|'[^'<]*')*+>",
    r"(?:\s+[^\s=>\"'/<]+(?:\s*=\s*(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s\"'<>]+))?)*+\s*/?>",
    r"[^<>]*>",
)
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)({'|'.join(_END)})|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_ONLY = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose text isn't the page's; controls end at the latest where a block begins or ends.
CONTROLS = frozenset("select button option datalist".split())
RAW = TEXT_ONLY | CONTROLS | frozenset("noscript template svg object canvas audio video annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle mpadded".split())
#: What an opening tag closes when it is still open, up to the nearest of its holders.
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer body form blockquote td th figure".split())
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address".split())

# Evidence of an ancestor: of its tag and of words in its class, id or role.
TAG_EVIDENCE = {"nav": -6.0, "aside": -6.0, "footer": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "fieldset": -4.0, "header": -4.0}
WORD_EVIDENCE = {
    **dict.fromkeys("article story post entry content main body text articlebody".split(), 1.0),
    **dict.fromkeys("ad ads adv advert advertisement advertising adbox promo promotion sponsor sponsored sponsors".split(), -6.0),
    **dict.fromkeys("cookie cookies consent gdpr notice popup modal paywall toast".split(), -6.0),
    **dict.fromkeys("comment comments reply replies discussion disqus".split(), -6.0),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs topbar pagination sitemap".split(), -6.0),
    **dict.fromkeys("sidebar aside related recommended recommendations trending newsletter signup login footer masthead".split(), -6.0),
    **dict.fromkeys("banner alert overlay disclaimer share sharing social subscribe subscription toolbar pager copyright legal header widget popular respond".split(), -4.0),
    **dict.fromkeys("rail reader foot head tabs tags search form".split(), -2.0),
}
#: First words of class names that tell a state, not what an element is.
STATES = frozenset("has with without no is js show hide can".split())
HIDDEN, ARTICLE, OWN, PATH = -7.0, 1.0, 2.0, 7.0
#: Smoothness of neighbours and of blocks of one parent; over a border of a named container it is ``BORDER`` of that.
SMOOTH_NEXT, SMOOTH_SIBLING, BORDER = 0.9, 0.9, 0.4
#: What a flow's arc has left at least to be open.
_LEAST = 1e-9

#: Pages that the regression is fitted on at most, and its weights before: of 1, words, link share, sentence end, heading,
#: paragraph, list item, place in the page.
SAMPLE = 400
START = np.array([-0.8, 0.6, -3.0, 0.6, 1.0, 0.5, -0.3, 0.0])


class _Element:
    __slots__ = ("tag", "parent", "depth", "good", "bad", "named", "chars", "head", "state")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.good = self.bad = 0.0
        self.named = tag in TAG_EVIDENCE or tag in ("article", "main", "section")
        self.chars, self.head, self.state = 0, tag in ("main", "h1"), None
        hidden = False
        if attributes and tag not in ("html", "body"):
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    self._take(value)
                elif name == "hidden":
                    hidden |= value.lower() not in ("false", "until-found")
                elif name == "aria-hidden":
                    hidden |= value.lower() == "true"
                elif name == "style":
                    hidden |= bool(_INVISIBLE.search(value))
        if hidden:
            self.bad = HIDDEN

    def _take(self, value: str) -> None:
        for token in value.split():
            words = [w.lower() for w in _NAME.findall(token)]
            if len(words) > 1 and words[0] in STATES:
                continue
            for w in words:
                e = WORD_EVIDENCE.get(w, 0.0)
                self.good, self.bad, self.named = max(self.good, e), min(self.bad, e), self.named or bool(e)

    def evidence(self, total: int) -> tuple[float, float, bool]:
        """What its path says for and against content, and whether an article or main holds it."""
        path: list[_Element] = []
        e = self
        while e is not None and e.state is None:
            path.append(e)
            e = e.parent
        for e in reversed(path):
            e._decide(total)
        return self.state  # type: ignore[return-value]

    def _decide(self, total: int) -> None:
        good, bad, inside = self.parent.state if self.parent else (0.0, 0.0, False)
        own, large = self.bad, 2 * self.chars > total and self.head
        if own > HIDDEN and large:  # it holds the page's heading and most of its text
            own /= 6
        elif own >= -4 and self.good:  # names for both
            own = min(0.0, own + 3.0)
        by_tag = TAG_EVIDENCE.get(self.tag, 0.0)
        if self.tag == "header" and inside:  # an article's own head
            by_tag = -0.5
        if self.tag == "form" and large:
            by_tag = 0.0
        low, other = sorted((bad, min(own, by_tag)))
        self.state = (max(good, self.good), low + other / 4, inside or self.tag in ("article", "main"))


def blocks(html: str) -> list[tuple[str, _Element, float]]:
    """A page's blocks in order: text, the element that holds it, the share of its characters within links."""
    root = _Element("", "", None)
    stack = [root]
    out: list = []
    parts: list[str] = []
    links = linked = 0
    at, n = 0, len(html)
    skip: str | None = None
    depth = 0

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                holder = stack[-1]
                while holder.tag in INLINE:
                    holder = holder.parent
                out.append((text, holder, min(1.0, linked / max(1, sum(map(len, parts))))))
                while holder is not None:
                    holder.chars += len(text)
                    holder = holder.parent
            parts, linked = [], 0

    for m in _TAG.finditer(html):
        if m.start() < at:  # inside a skipped element
            continue
        if m.start() > at and skip is None:
            piece = html[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if skip is not None:
            if skip in CONTROLS and tag in BLOCKS:  # never closed
                skip = None
            else:
                if tag == skip:
                    depth += -1 if m[1] else 0 if m[3].endswith("/>") or skip in CONTROLS else 1
                    if depth == 0:
                        skip = None
                continue
        if m[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
            else:
                close_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            if tag in ("select", "button", "textarea"):
                close_block()
            if m[3].endswith("/>") and tag not in TEXT_ONLY:
                continue
            end = re.compile(f"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*>", re.I).search(html, at)
            if tag in TEXT_ONLY:
                at = end.end() if end else n
            elif end or tag in CONTROLS:
                skip, depth = tag, 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close_block()
            if tag in VOID:
                continue
            links = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES.get(tag, ()) or (tag not in CLOSES and stack[k].tag == "p"):
                    del stack[k:]
                    break
                if stack[k].tag in HOLDERS:
                    break
        elif tag in VOID:
            continue
        links += tag == "a"
        stack.append(_Element(tag, m[3][:-1], stack[-1]))
        if stack[-1].head:
            for e in stack:
                e.head = True
    if skip is None and at < n:
        parts.append(html[at:])
    close_block()
    return out


def looks(found: list[tuple[str, _Element, float]]) -> np.ndarray:
    """The regression's inputs, one row a block; nothing in them names an ancestor."""
    out = np.empty((len(found), len(START)))
    for k, (text, holder, share) in enumerate(found):
        tag = holder.tag
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        end = text[-1] in ".!?:;…\"'”»" and text[0] != "©"
        out[k] = (1.0, min(4.0, np.log1p(text.count(" "))), share, end, heading, tag in ("p", "pre", "blockquote", "figcaption"), tag == "li", abs(2 * (k + 0.5) / len(found) - 1))
    return out


def _known(found: list[tuple[str, _Element, float]]) -> np.ndarray:
    """1: its page says that the block is content; 0: that it is boilerplate; -1: neither, or both."""
    out = np.full(len(found), -1)
    for k, (_, holder, _) in enumerate(found):
        tags, against, e = set(), False, holder
        while e is not None:
            tags.add(e.tag)
            against |= e.bad < 0
            e = e.parent
        if tags & {"nav", "footer", "aside", "header", "form"}:
            out[k] = 0
        elif tags & {"article", "main"} and not against:
            out[k] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, both kinds weighing the same, held near ``START`` by a penalty; Newton steps."""
    w = START.copy()
    if len(y) and 0 < y.sum() < len(y):
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (p - y)) / len(y) + 0.02 * (w - START)
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + 0.02 * np.eye(len(w))
            w = w - np.linalg.solve(curve, slope)
    return w


def costs(found: list[tuple[str, _Element, float]], weights: np.ndarray = START) -> list[float]:
    """Each block's log odds of being content."""
    if not found:
        return []
    total = sum(len(t) for t, _, _ in found)
    own = np.clip(looks(found) @ weights, -OWN, OWN).tolist()
    out = []
    for (text, holder, _), o in zip(found, own, strict=True):
        good, bad, inside = holder.evidence(total)
        if text[0] == "©" or text.lower().startswith("copyright"):
            o -= 2.0
        out.append(o + max(-PATH, min(PATH, ARTICLE * inside + good + bad)))
    return out


def smoothness(found: list[tuple[str, _Element, float]]) -> dict[tuple[int, int], float]:
    """Edges of blocks that follow each other and of blocks of one parent, by how far apart they are in the tree."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, bool], int] = {}
    for k, (_, holder, _) in enumerate(found):
        if k:
            a, b, steps, border = found[k - 1][1], holder, 0, False
            while a is not b:
                deep = a if a.depth >= b.depth else b
                border |= deep.named
                steps += 1
                if deep is a:
                    a = a.parent
                else:
                    b = b.parent
            edges[k - 1, k] = SMOOTH_NEXT * (BORDER if border else 1.0) / (1 + max(0, steps - 2) / 2)
        kind = id(holder.parent), holder.named  # a paragraph's sibling is the paragraph before, past an advert
        if kind in last:
            edges[last[kind], k] = edges.get((last[kind], k), 0.0) + SMOOTH_SIBLING * (BORDER if holder.named else 1.0)
        last[kind] = k
    return edges


def minimum_cut(cost: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) that minimise what is paid for labels against their cost and for edges between labels.

    cost[i] > 0 is paid when i is called boilerplate, -cost[i] > 0 when it is called content. A maximum flow from the
    content terminal to the other one, by blocking flows in graphs of shortest distances, leaves the content on its side.
    """
    n = len(cost)
    to: list[int] = []  # arc k and its reverse k ^ 1
    left: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    source, sink = n, n + 1
    for k, c in enumerate(cost):
        link(source, k, c, 0.0) if c > 0 else link(k, sink, -c, 0.0)
    for (a, b), w in edges.items():
        link(a, b, w, w)
    while True:
        far = [-1] * (n + 2)
        far[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for k in arcs[a]:
                if left[k] > _LEAST and far[to[k]] < 0:
                    far[to[k]] = far[a] + 1
                    queue.append(to[k])
        if far[sink] < 0:
            return [d >= 0 for d in far[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        while True:
            a = to[path[-1]] if path else source
            if a == sink:
                w = min(left[k] for k in path)
                for k in path:
                    left[k] -= w
                    left[k ^ 1] += w
                del path[next(i for i, k in enumerate(path) if left[k] <= _LEAST) :]
                continue
            while tried[a] < len(arcs[a]) and not (left[arcs[a][tried[a]]] > _LEAST and far[to[arcs[a][tried[a]]]] == far[a] + 1):
                tried[a] += 1
            if tried[a] < len(arcs[a]):
                path.append(arcs[a][tried[a]])
            elif path:
                path.pop()
                tried[to[path[-1]] if path else source] += 1
            else:
                break


def labelled(found: list[tuple[str, _Element, float]], weights: np.ndarray = START) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    return minimum_cut(costs(found, weights), smoothness(found))


def main_text(html: str | None, weights: np.ndarray = START) -> str:
    """The text of a page's content blocks."""
    found = blocks(html or "")
    return "\n".join(t for (t, _, _), keep in zip(found, labelled(found, weights), strict=True) if keep)


def fitted(pages: DataFrame) -> np.ndarray:
    """The regression's weights, from the blocks of ``SAMPLE`` pages at most; only sums of theirs would grow with a page."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for html in batch.column(0).to_pylist():
                found = blocks(html or "")
                y = _known(found)
                x = looks(found)[y >= 0].tolist()
                y = y[y >= 0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    html = F.col("html").cast("string")
    least = pages.select(F.xxhash64(html).alias("h")).where(html.isNotNull()).distinct().orderBy("h").limit(SAMPLE)
    some = pages.select(html.alias("html")).withColumn("h", F.xxhash64("html")).join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"])
    got = some.select("html").mapInArrow(rows, "x array<double>, y int").toPandas().sort_values("y", kind="stable")
    if not len(got):
        return START
    x, y = np.stack(got["x"].to_list()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # so that reruns add up the same numbers in the same order
    return fit(x[order], y[order])


def extract(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    spark = pages.sparkSession
    C.bounded_batches(spark)
    weights = fitted(pages)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            text = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], [id_column, "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows, f"`{id_column}` {kind}, url string, text string, n_chars long")
