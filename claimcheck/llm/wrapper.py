"""Main text of web pages by wrapper induction.

The block elements of a page form a tree; adjacent siblings of one label (tag, class, id) are one
repeating node. The trees of all pages of a host are aligned by simple tree matching, the largest
order-preserving match of nodes with equal labels, and merged into the host's wrapper: for each node the
number of pages that have it, its text as long as all of them agree on it, and how much text and how much
of that in links it has on all of them. Nodes of constant text are template. From the root of a page the
way goes to the child whose varying slots hold, by the wrapper, more than half of the text outside links,
as long as that child is a container; where it ends is the content. Elements that say that they are menus,
adverts and the like are no content; an article or main element around the content is taken as a whole,
and decides where the wrapper does not.

Pages are parsed where they are read. Each task merges its own pages of a host first, so a host with
most of the pages sends one small tree for each task. Of a node with many children those of few pages are
folded into one for each tag, so names that are made up for every page do not add up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import written

OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
SPECIAL = re.compile(r"[>\"']")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that ends open ones of these tags, within the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ASIDE_TAGS = frozenset("nav aside footer form button select dialog menu head object audio video canvas".split())
ASIDE_NAMES = frozenset("ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices alert popup modal overlay comment comments disqus reply replies respond newsletter subscribe signup login search share sharing social related recommended contentinfo complementary dialog form".split())
MAIN_TAGS = ("article", "main")
#: A node is template only in a wrapper of at least so many different pages.
LEAST_PAGES = 3
#: Of more children than WIDE those found on less than one in RARE of their parent's pages are folded.
WIDE, RARE = 100, 20


@dataclass
class Element:
    tag: str
    names: str = ""
    parts: list = field(default_factory=list)

    def aside(self, inside: bool) -> bool:
        words = re.split(r"[^a-z]+", self.names.lower())
        return self.tag in ASIDE_TAGS or self.tag == "header" and not inside or self.tag not in ("body", "html", "article", "main") and not ASIDE_NAMES.isdisjoint(words) or self.tag == "article" and not {"comment", "comments", "ad", "advert"}.isdisjoint(words)


class Markup:
    """Where the tags of a page end, in time linear in the page, also where tags and quotes stay open."""

    def __init__(self, html: str):
        self.html, self.begin, self.special, self.open = html, 0, -1, set()
        self.last = html.rfind(">")

    def end(self, at: int) -> int:
        """The place of the > that ends a tag's attributes from a place on, quoted ones skipped; -1 if none does."""
        seen = []
        while True:
            if not self.begin <= at <= self.special:
                found = SPECIAL.search(self.html, at)
                self.begin, self.special = at, found.start() if found else len(self.html)
            stop = self.special
            if stop == len(self.html) or stop in self.open:
                break
            if self.html[stop] == ">":
                return stop
            seen.append(stop)
            at = self.html.find(self.html[stop], stop + 1) + 1
            if not at:
                break
        self.open.update(seen)
        return -1

    def tokens(self, at: int) -> Iterator[tuple[int, int, str, str, str]]:
        """Start, end, slash, name and attributes of each tag; no name for comments and declarations.

        A place sent to the iterator is where the next tag is looked for.
        """
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                close = html.find("-->", at + 4)
                token = at, close + 3 if close >= 0 else len(html), "", "", ""
            elif (name := OPENING.match(html, at)) and (close := self.end(name.end())) >= 0:
                token = at, close + 1, name[1], name[2].lower(), html[name.end() : close]
            elif html[at + 1 : at + 2] in ("!", "?", "/") and at < self.last:
                token = at, html.find(">", at) + 1, "", "", ""
            else:
                at += 1
                continue
            to = yield token
            at = token[1] if to is None else to


def parse(html: str) -> Element:
    """The tree of a page. Raw elements, comments and declarations are left out; open elements end at the end."""
    root, at, end = Element("html"), 0, len(html)
    stack, places, body = [root], {}, None
    tokens = Markup(html).tokens(0)

    def cut(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def nearest(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str], bounds: set[str]) -> None:
        if (to := nearest(tags)) > nearest(bounds - tags):
            cut(to)

    token = next(tokens, None)
    while at < end:
        text = html[at : token[0] if token else end]
        if text:
            stack[-1].parts.append(unescape(text) if "&" in text else text)
        if not token:
            break
        _, at, slash, tag, rest = token
        if tag and slash:
            if to := nearest([tag]):
                cut(to)
        elif tag in RAW:
            if not rest.endswith("/"):
                closing = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = (html.find(">", closing.end()) if closing else -1) + 1 or end
        elif tag == "head":
            body = html.find("<body", at) if body is None or 0 <= body < at else body
            at = max(at, body)
        elif tag and tag not in ("html", "body"):
            if tag in CLOSES_P:
                close({"p"}, {"td", "th", "button", "table"})
            if tag in ENDS:
                close(*ENDS[tag])
            element = Element(tag, " ".join(a or b or c for _, a, b, c in NAMED.findall(rest)) if "=" in rest else "")
            stack[-1].parts.append(element)
            if tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                stack.append(element)
        try:
            token = tokens.send(at)
        except StopIteration:
            token = None
    return root


def parts(element: Element, enter: Callable[[Element], bool]) -> Iterator[str | Element]:
    """The parts of an element in page order; in place of elements to enter come their own parts."""
    around = [iter(element.parts)]
    while around:
        part = next(around[-1], None)
        if part is None:
            around.pop()
        elif isinstance(part, str) or not enter(part):
            yield part
        else:
            around.append(iter(part.parts))


@dataclass
class Node:
    """A block element, or a run of equal siblings, of a page or wrapper. text: None where it varies.

    chars, linked and count add up over pages: characters of its own text, those in links, elements.
    """

    label: str
    pages: int = 1
    text: int | None = 0
    chars: int = 0
    linked: int = 0
    count: int = 1
    children: list[Node] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    own: float = 0
    mass: float = 0

    def plain(self) -> list:
        return [self.label, self.pages, self.text, self.chars, self.linked, self.count, [c.plain() for c in self.children]]

    @classmethod
    def of(cls, plain: list) -> Node:
        return cls(*plain[:6], [cls.of(c) for c in plain[6]])

    @property
    def tag(self) -> str:
        return self.label.partition(".")[0]

    def weigh(self, pages: int) -> Node:
        """Sets own and mass, of it and below: varying text outside links for each page that has the node."""
        self.own = 0 if constant(self, pages) else max(0, self.chars - 2 * self.linked) / self.pages
        self.mass = self.own + sum(c.weigh(pages).mass * c.pages for c in self.children) / self.pages
        return self


def inline(element: Element) -> bool:
    return element.tag in INLINE


def _own_text(element: Element) -> str:
    return "".join(part if isinstance(part, str) else " " for part in parts(element, inline))


def _blocks(element: Element) -> Iterator[Element]:
    return (part for part in parts(element, inline) if not isinstance(part, str) and part.tag not in VOID)


def _linked(element: Element) -> int:
    links = parts(element, lambda part: inline(part) and part.tag != "a")
    return sum(len(" ".join(_own_text(part).split())) for part in links if not isinstance(part, str) and part.tag == "a")


def tree(element: Element, depth: int = 0, aside: bool = False, inside: bool = False) -> Node:
    """The block tree of an element; blocks below 60 levels are not in it, so they never count as template.

    What says that it is aside weighs nothing.
    """
    label = element.tag + "." + re.sub(r"\d+", "#", element.names)
    inside = inside or element.tag in MAIN_TAGS
    aside = aside or element.aside(inside)
    text = " ".join(_own_text(element).split())
    node = Node(label, 1, crc32(text.encode()), 0 if aside else len(text), 0 if aside else _linked(element), elements=[element])
    for block in _blocks(element) if depth < 60 else ():
        child = tree(block, depth + 1, aside, inside)
        if node.children and node.children[-1].label == child.label:
            node.children[-1] = merge(node.children[-1], child, 0)
        else:
            node.children.append(child)
    return node


def alike(x: Node, y: Node) -> bool:
    """Nodes of one label, or of one tag where one of them is folded."""
    return x.label == y.label or (x.label.endswith(".*") or y.label.endswith(".*")) and x.tag == y.tag


def matched(a: list[Node], b: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """Size and pairs of the largest order-preserving match of two lists of trees."""
    if [x.label for x in a] == [y.label for y in b]:
        return sum(1 + matched(x.children, y.children)[0] for x, y in zip(a, b, strict=True)), [(i, i) for i in range(len(a))]
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best = max(size[i][j + 1], size[i + 1][j])
            if alike(x, y):
                gain[i, j] = 1 + matched(x.children, y.children)[0]
                best = max(best, size[i][j] + gain[i, j])
            size[i + 1][j + 1] = best
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if (i - 1, j - 1) in gain and size[i][j] == size[i - 1][j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif size[i][j] == size[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return size[-1][-1], pairs[::-1]


def merge(a: Node, b: Node, more: int = 1) -> Node:
    """Both trees, aligned, in one. more=0: siblings of one page, which make a repeating node of no fixed text."""
    children, i, j = [], 0, 0
    for x, y in [*matched(a.children, b.children)[1], (len(a.children), len(b.children))]:
        children += [*a.children[i:x], *b.children[j:y]]
        if x < len(a.children):
            children.append(merge(a.children[x], b.children[y], more))
        i, j = x + 1, y + 1
    pages, text = a.pages + more * b.pages, a.text if more and a.text == b.text else None
    label = b.label if b.label.endswith(".*") else a.label
    return Node(label, pages, text, a.chars + b.chars, a.linked + b.linked, a.count + b.count, folded(children, pages), a.elements + b.elements)


def folded(children: list[Node], pages: int) -> list[Node]:
    """Of many children, those of few pages become one for each tag, where the first of them stood."""
    if len(children) <= WIDE or pages < RARE:
        return children
    out, rare = [], {}
    for child in children:
        if child.pages * RARE >= pages:
            out.append(child)
        elif child.tag in rare:
            at = rare[child.tag]
            out[at] = merge(out[at], child)
        else:
            rare[child.tag] = len(out)
            child.label = child.tag + ".*"
            out.append(child)
    return out


EMPTY = crc32(b"")


def constant(node: Node, pages: int) -> bool:
    """Is a wrapper's node template: one text on at least half of the host's pages?"""
    return node.text is not None and node.text != EMPTY and 2 * node.pages >= pages and node.pages >= LEAST_PAGES


def template_of(page: Node, wrapper: Node) -> set[int]:
    """The elements of a page (by id()) whose own text is template: constant over the host's pages."""
    found: set[int] = set()

    def walk(a: Node, b: Node) -> None:
        if constant(b, wrapper.pages):
            found.update(map(id, a.elements))
        for i, j in matched(a.children, b.children)[1]:
            walk(a.children[i], b.children[j])

    walk(page, wrapper)
    return found


def content_of(page: Node, wrapper: Node) -> Element | None:
    """The element that holds a page's varying text by the weights of the (weighed) wrapper; None if undecided."""
    at, of = page, wrapper
    while at.children:
        pairs = dict(matched(at.children, of.children)[1])
        around = [of.children[pairs[i]] if i in pairs else c.weigh(wrapper.pages) for i, c in enumerate(at.children)]
        best = max(range(len(around)), key=lambda i: around[i].mass)
        child = at.children[best]
        container = 2 * around[best].own < around[best].mass
        if not container or child.count > 1 or 2 * around[best].mass <= of.own + sum(c.mass for c in around):
            break
        at, of = child, around[best]
    return at.elements[0] if at is not page else None


def mains_of(root: Element, tag: str) -> list[Element]:
    """The outermost elements of a tag that stand in no menu, advert and the like."""

    def main(element: Element) -> bool:
        return element.tag == tag or tag == "main" and "main" in element.names.lower().split()

    def enter(element: Element) -> bool:
        return not element.aside(True) and not main(element)

    return [part for part in parts(root, enter) if not isinstance(part, str) and not part.aside(True)]


def below(element: Element) -> set[int]:
    """The elements inside another one, by id()."""
    found: set[int] = set()

    def enter(part: Element) -> bool:
        found.add(id(part))
        return True

    for _ in parts(element, enter):
        pass
    return found


def mains_with(root: Element, content: Element | None) -> list[Element]:
    """The content, or the main element that holds it or stands in it; all main elements where none is known."""
    mains = next(filter(None, (mains_of(root, tag) for tag in MAIN_TAGS)), [])
    if content is None:
        return mains
    around = [main for main in mains if main is content or id(content) in below(main)]
    within = below(content)
    return around or [main for main in mains if id(main) in within] or [content]


def text_of(root: Element, template: set[int], content: Element | None = None) -> str:
    """The blocks of the content (all of the page where there is none), one space between them."""
    mains = mains_with(root, content)
    inside, blocks = bool(mains), [[]]
    for main in mains or [root]:
        blocks.append([])
        around = [(iter(main.parts), id(main) not in template, True)]
        while around:
            rest, own, block = around[-1]
            part = next(rest, None)
            if part is None:
                around.pop()
                if block:
                    blocks.append([])
            elif isinstance(part, str):
                if own:
                    blocks[-1].append(part)
            elif not part.aside(inside):
                block = not inline(part)
                if block:
                    blocks.append([])
                around.append((iter(part.parts), id(part) not in template if block else own, block))
    return " ".join(x for b in blocks if (x := " ".join("".join(b).split())))


def host() -> Column:
    """The host of a url in lower case, without its port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _folded(pages: DataFrame) -> DataFrame:
    """host, part and wrapper of the pages of each host in each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), {}

        def out() -> pa.RecordBatch:
            names, texts = list(found), [json.dumps([sorted(t), w.plain()]) for t, w in found.values()]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([part] * len(names), pa.int32()), pa.array(texts, pa.string())], names=["host", "part", "wrapper"])

        for batch in batches:
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = tree(parse(html))
                texts, wrapper = found.get(name, (set(), None))
                if len(texts) < LEAST_PAGES:
                    texts.add(crc32(html.encode()))
                page.elements.clear()
                found[name] = (texts, merge(wrapper, page) if wrapper else page)
                _forget(found[name][1])
            if len(found) > 5000:
                yield out()
                found.clear()
        if found:
            yield out()

    return pages.select("host", "html").mapInArrow(rows, "host string, part int, wrapper string")


def _forget(node: Node) -> None:
    node.elements = []
    for child in node.children:
        _forget(child)


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    texts, wrapper = set(), None
    for found, plain in map(json.loads, rows["wrapper"]):
        texts |= set(found)
        wrapper = merge(wrapper, Node.of(plain)) if wrapper else Node.of(plain)
    head = rows[["host", "part"]].iloc[:1]
    return head.assign(wrapper=json.dumps([sorted(texts)[:LEAST_PAGES], wrapper.plain()]))


def induce(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of all pages; the trees of a host's tasks meet in two rounds."""
    schema = "host string, part int, wrapper string"
    some = _folded(pages).withColumn("part", F.expr("part div 64"))
    return some.groupBy("host", "part").applyInPandas(_joined, schema).groupBy("host").applyInPandas(_joined, schema).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty html gives an empty text. Pages without a host share one wrapper. Repeated rows and
    ids are kept; other columns are ignored, whatever their names; an empty table gives no rows. Where a
    host has fewer than three different pages nothing counts as template and the names of elements decide, so copies of one
    page keep their text. Pages of any length and depth are parsed whole, in time linear in their length.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host())
    wrappers = written(induce(rows))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for html, wrapper in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if wrapper not in known:
                        if len(known) > 1000:
                            known.clear()
                        seen, plain = json.loads(wrapper)
                        node = Node.of(plain)
                        known[wrapper] = node.weigh(node.pages) if len(seen) >= LEAST_PAGES else None
                    root, of = parse(html), known[wrapper]
                    page = tree(root) if of else None
                    out.append(text_of(root, template_of(page, of), content_of(page, of)) if of else text_of(root, set()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(wrappers, "host").select("page_id", "url", "html", "wrapper").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
