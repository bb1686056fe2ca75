"""Main text of web pages by a tree-structured graphical model.

A page is parsed to its element tree. Each element has a hidden state: ``BOILER``, ``CONTENT`` or ``MIXED`` (it holds both
kinds below it). Node potentials score what is seen of the element (its tag, words of its class and id, its share of linked text, the length
of its own text); parent-child potentials tie each element to the one above it. Sum-product messages go upward and then
downward once, which gives each element's exact marginals; text stands in the output unless its element is more likely
``BOILER`` than not. All potentials, the root's too, are counted from labelled pages (``training_pages``), at start, on the driver: a few pages.

Blocks: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
an empty line in page order; empty blocks are left out, nothing else is. Scripts, styles, comments, page titles, lists of
choices and text fields have no text; formulas, drawings and fallbacks in the article are text of the line they stand in.

Defined cases: a null html is an empty page and gives an empty text. Unclosed, stray and unknown tags are repaired as
browsers mostly do; a page without tags is one block. A tag that never ends is text, as nothing after it can be a tag; a quote
that never ends is no quote; a field or list of choices that never ends is empty; a script or style that never ends, or a comment, takes the rest of
the page. Null and repeated ids are rows like any other. Other columns are ignored. Pages are parsed in time linear in their
length, however deep, and walked without recursion.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .training_pages import PAGES

BOILER, CONTENT, MIXED = 0, 1, 2
OUT = "page_id long, url string, text string, n_chars long"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Those of the second set end the page if they don't end.
RAW = frozenset("script style template iframe textarea select title xmp noembed noframes datalist".split())
ENDLESS = frozenset(("script", "style"))
#: Foreign content: all below it stands in the line.
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button canvas cite code data del dfn em font i input ins kbd label mark math nobr noscript object output q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr img br".split()
)
#: An opening tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split()
)
_COMMENT = re.compile(r"--!?>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "parent", "parts", "own", "link", "text", "label", "inline")

    def __init__(self, tag: str, attrs: str, parent: int, inside: bool = False):
        self.tag, self.parent = tag, parent
        self.inline = inside or tag in INLINE
        self.words: set[str] = set()
        self.label: int | None = None
        for m in _ATTR.finditer(attrs) if attrs else ():
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                self.words.update(w.lower() for w in _WORD.findall(html_lib.unescape(value)))
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                self.words.add("hidden")
            elif name == "data-label":
                self.label = {"content": CONTENT, "boiler": BOILER}[value]
        self.parts: list = []  # child numbers and texts, in order
        self.own = self.link = self.text = 0


class _Open:
    """The open elements, and where those of each tag stand."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.at, self.paragraph = nodes, [], {}, []

    def push(self, k: int) -> None:
        tag = self.nodes[k].tag
        self.at.setdefault(tag, []).append(len(self.stack))
        # the open paragraph that only inline elements separate from here
        self.paragraph.append(len(self.stack) if tag == "p" else self.paragraph[-1] if tag in INLINE and self.paragraph else -1)
        self.stack.append(k)

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.paragraph.pop()
            self.at[self.nodes[self.stack.pop()].tag].pop()


class _Tags:
    """Where tags end: at the first > outside quotes. Quotes that never end are none. Every search that fails is the last of its kind."""

    def __init__(self, page: str):
        self.page, self.dead, self.missing = page, set(), set()

    def end(self, at: int) -> int:
        """The place of the >, or -1."""
        page, n = self.page, len(self.page)
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= n:
                return -1
            c = page[at]
            if c == ">":
                return at
            close = -1 if c in self.dead else page.find(c, at + 1)
            if close < 0:
                self.dead.add(c)
            at = max(at, close) + 1

    def closing(self, tag: str, at: int) -> int:
        """The place after the closing tag, or -1."""
        m = None if tag in self.missing else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if m is None:
            self.missing.add(tag)
            return -1
        return m.end()


def parse(page: str) -> list[Node]:
    """Elements in document order; the first is the page itself."""
    nodes, at, n = [Node("#page", "", -1)], 0, len(page)
    tags, held = _Tags(page), _Open(nodes)
    held.push(0)

    def text(raw: str) -> None:
        if raw:
            nodes[held.stack[-1]].parts.append(html_lib.unescape(raw))

    begin = 0  # of text that isn't taken yet
    while (at := page.find("<", at)) >= 0:
        c = page[at + 1 : at + 2]
        if c == "!" or c == "?":
            text(page[begin:at])
            if page.startswith("<!--", at):
                m = _COMMENT.search(page, at + 2)
                stop = m.end() if m else n
            else:
                stop = page.find(">", at) + 1 or n
            begin = at = stop
            continue
        closing = c == "/"
        m = _NAME.match(page, at + 1 + closing)
        if m is None:
            if closing:  # no tag: a comment to the next >
                text(page[begin:at])
                begin = at = page.find(">", at) + 1 or n
            else:
                at += 1
            continue
        end = tags.end(m.end())
        if end < 0:
            break  # nothing after this can be a tag
        text(page[begin:at])
        tag, attrs = m[0].lower(), page[m.end() : end]
        begin = at = end + 1
        if closing:
            k = held.last(tag)
            if k > 0 and not (tag in INLINE and held.last("table", "article", "body") > k):
                held.cut(k)
            continue
        if tag in P_ENDS and held.paragraph[-1] > 0:
            held.cut(held.paragraph[-1])
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            while (k := held.last(*ends)) > 0 and k > held.last(*stops):
                held.cut(k)
                if tag != "tr":
                    break
        over = nodes[held.stack[-1]]
        nodes.append(Node(tag, attrs, held.stack[-1], over.tag in FOREIGN or over.inline and over.tag not in INLINE))
        over.parts.append(len(nodes) - 1)
        if attrs.endswith("/") and (tag not in P_ENDS or tag in VOID):
            continue
        if tag in RAW and not (tag == "title" and nodes[-1].inline):
            stop = tags.closing(tag, at)
            if stop >= 0 or tag in ENDLESS:
                begin = at = stop if stop >= 0 else n
        elif tag not in VOID:
            held.push(len(nodes) - 1)
    text(page[begin:])
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        x.own = sum(len(t.strip()) for t in x.parts if isinstance(t, str))
        x.text += x.own
        if x.tag == "a":
            x.link = x.text
        if x.parent >= 0:
            nodes[x.parent].text += x.text
            nodes[x.parent].link += x.link
    return nodes


def features(x: Node) -> list[str]:
    tag = x.tag if not re.fullmatch(r"h[2-6]", x.tag) else "h2"
    share = x.link / x.text if x.text else 0.0
    out = [f"tag={tag}", f"link={'none' if share == 0 else 'some' if share < 0.34 else 'much' if share < 0.75 else 'all'}"]
    out.append(f"own={min(4, int(math.log2(x.own + 1) / 2))}")
    out += [f"word={w}" for w in sorted(x.words)] or [f"bare={tag}"]
    return out


class Model:
    """Log potentials: node features by state, states of child by parent, and of the page."""

    def __init__(self, pages: list[str]):
        states, pairs, seen, top = Counter(), Counter(), Counter(), Counter()
        for page in pages:
            nodes = parse(page)
            y = self.states(nodes)
            top[y[0]] += 1
            for x, s in zip(nodes, y, strict=True):
                states[s] += 1
                seen.update((f, s) for f in set(features(x)))
                if x.parent >= 0:
                    pairs[y[x.parent], s] += 1
        self.node: dict[str, tuple[float, ...]] = {}
        for f in {f for f, _ in seen}:
            rare = (0.2, 0.2, 0.02)  # only wrappers are mixed
            each = [(seen[f, s] + rare[s]) / (states[s] + 2.0) for s in range(3)]
            mean = sum(each) / 3
            strong = 1.2 if f.startswith(("word=", "tag=", "bare=")) else 0.5
            self.node[f] = tuple(strong * math.log(e / mean) for e in each)
        self.root = [(top[s] + 1) / (len(pages) + 3) for s in range(3)]
        below = [sum(pairs[p, c] for c in range(3)) for p in range(3)]
        # a mixed element's parts are of any kind; nothing under boilerplate is content again
        self.pair = [[(pairs[p, c] + (0.05 if p == BOILER else 0.5)) / (below[p] + 1.5) for c in range(3)] for p in range(3)]

    @staticmethod
    def states(nodes: list[Node]) -> list[int]:
        """From labels: an element has the label of the nearest element above it that has one; above all labels, what it holds."""
        y: list[int | None] = []
        for x in nodes:
            y.append(x.label if x.label is not None else (y[x.parent] if x.parent >= 0 else None))
        out = [MIXED if s is None else s for s in y]
        holds = [s == BOILER and y[k] is not None for k, s in enumerate(out)]
        for k in range(len(nodes) - 1, 0, -1):  # content with labelled boilerplate below is mixed only where it says so
            if holds[k] and nodes[k].parent >= 0 and y[nodes[k].parent] is None:
                holds[nodes[k].parent] = False
        return out

    def unary(self, x: Node) -> list[float]:
        out = [0.0, 0.0, 0.0]
        for f in features(x):
            if (v := self.node.get(f)) is not None:
                out[0] += v[0]
                out[1] += v[1]
                out[2] += v[2]
        top = max(out)
        return [math.exp(v - top) for v in out]

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Sum-product: up to the page, then down again."""
        n, pair = len(nodes), self.pair
        belief = [self.unary(x) for x in nodes]
        belief[0] = [b * r for b, r in zip(belief[0], self.root, strict=True)]
        up: list[list[float]] = [[1.0, 1.0, 1.0]] * n
        for k in range(n - 1, 0, -1):  # children come after their parent
            b = belief[k]
            m = [row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in pair]
            z = sum(m)
            up[k] = m = [v / z for v in m]
            p = belief[nodes[k].parent]
            q = [p[0] * m[0], p[1] * m[1], p[2] * m[2]]
            z = sum(q)
            belief[nodes[k].parent] = [v / z for v in q]
        z = sum(belief[0])
        belief[0] = [v / z for v in belief[0]]
        for k in range(1, n):
            p, u, b = belief[nodes[k].parent], up[k], belief[k]
            rest = [p[s] / max(u[s], 1e-300) for s in range(3)]
            q = [b[c] * sum(rest[s] * pair[s][c] for s in range(3)) for c in range(3)]
            z = sum(q)
            belief[k] = [v / z for v in q]
        return belief


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model(list(PAGES))


def extract(page: str, model: Model) -> str:
    nodes = parse(page)
    belief = model.marginals(nodes)
    blocks, now = [], []

    def flush() -> None:
        block = _SPACE.sub(" ", "".join(now)).strip()
        if block:
            blocks.append(block)
        now.clear()

    todo: list[tuple[int, int]] = [(0, 0)]  # element, next of its parts
    while todo:
        k, j = todo.pop()
        x = nodes[k]
        if j == 0 and not x.inline:
            flush()
        if j < len(x.parts):
            part = x.parts[j]
            todo.append((k, j + 1))
            if isinstance(part, int):
                child = nodes[part]
                if child.tag == "br":
                    now.append(" ")
                elif child.parts:
                    todo.append((part, 0))
                elif not child.inline:
                    flush()
            elif belief[k][BOILER] < 0.5:
                now.append(part)
        elif not x.inline:
            flush()
    flush()
    return "\n\n".join(blocks)


def _extract_batches(model: Model):
    def run(batches):
        for t in batches:
            texts = [extract(x or "", model) for x in t.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("page_id"), t.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract_batches(model or trained()), OUT)
