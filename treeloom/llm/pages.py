"""Main text of web pages with wrappers inferred for each host.

The nested token streams of a host's pages are aligned one after the other: what some pages
lack becomes an optional group, what follows itself a repeated group, text that differs a
slot, until one union-free expression stands for all of them. The element that holds the
repeated and other text slots with most of the prose is the host's content. Beside it, places
are counted over all different pages: a place is the path of tags, classes and ids to a block
of text, and a text on most of the pages that have its place is a constant, be the place on
every page or optional, single or repeated. Every page is matched against the wrapper of its
host: the slots of the content are its text, constants are furniture. Tags and class words
are hints: article marks go before the wrapper's choice of content, class words decide where
it has none, and both decide where a host has too few pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import isqrt

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm._store import materialise, own_name, sized

#: Different pages that must have a text at one place before it counts as constant.
LEAST = 3
#: Signs of a slot's mean text from which it is prose, whatever a word in its class says.
PROSE = 60
#: Elements deeper than this are read as text of the element above.
DEPTH = 64
#: Share of an element's prose that one element within must hold to be the content in its place.
MOST = 0.7
#: Signs of a constant that a wrapper shows; longer ones are known by a hash.
SHOWN = 200
#: Wrappers of a host that are aligned in one task at a time, on average.
TOGETHER = 256

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]++|<)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "xmp", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_DROPPED = frozenset("nav footer aside form head button select option menu dialog object canvas audio video map fieldset".split())
_CLOSES_LIKE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header footer masthead sidebar aside cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus replies responses related recommended widget search pagination pager toolbar skip copyright complementary contentinfo".split()
)
_NEVER_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments disqus replies related recommended teaser".split())
_REGION = frozenset("content post entry story articlebody".split())


def _clean(raw: str) -> str:
    """Text with character references decoded and single spaces."""
    return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


def _names(attributes: str) -> tuple[str, frozenset[str], bool]:
    """class and id as they stand, the words in class, id and role, and whether the element is hidden."""
    if not attributes or attributes.isspace():
        return "", frozenset(), False
    own, hidden = {}, False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            own[name] = value.lower()
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
    return f"{own.get('class', '')}#{own.get('id', '')}", frozenset(re.split(r"[^a-z0-9]+", " ".join(own.values()))), hidden


@dataclass
class Text:
    """A run of text with what is known of its place."""

    place: int  # the path of the block
    block: int
    dropped: bool
    doubtful: bool  # within an article, an element has a class word of furniture
    article: bool
    region: bool
    outside: bool  # outside of articles, an element has a class word of furniture
    content: bool  # within the content of the host's wrapper
    raw: str


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): open, close, text; comments and declarations are left out, raw elements too."""
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        if not m:  # a tag without an end: text, as it stands
            yield "text", html[at], ""
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            yield "text", m[4], ""
        elif m[2]:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
            elif name in _RAW:
                if not m[3].endswith("/"):
                    closed = _RAW[name].search(html, at)
                    at = closed.end() if closed else end
            else:
                yield "open", name, m[3]


def texts(html: str, regions: frozenset[int] = frozenset(), root: Node | None = None) -> list[Text]:
    """All runs of text of a page outside raw elements, in page order.

    regions: paths that are the content of the host's wrapper. root: the page's elements and texts are put below it.
    """
    out: list[Text] = []
    # name, path, node, and the flags of its texts: place, dropped, doubtful, article, region, outside, content
    stack: list[tuple] = [("", 0, root, (0, False, False, False, False, False, False))]
    count: dict[str, int] = {}
    block = 0

    def add(raw: str) -> None:
        _, _, node, (place, *flags) = stack[-1]
        out.append(Text(place, block, *flags, raw))
        if node is not None and not raw.isspace():
            node.inner.append(Node("#", text=raw))

    def pop() -> None:
        nonlocal block
        name = stack.pop()[0]
        count[name] -= 1
        block += name not in _INLINE

    def close(name: str, stop: tuple[str, ...] = ()) -> None:
        if count.get(name):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stop:
                    return
                if stack[i][0] == name:
                    while len(stack) > i:
                        pop()
                    return

    for kind, name, rest in tokens(html):
        if kind == "text":
            add(name)
        elif kind == "close":
            if name == "br":
                add(" ")
            else:
                close(name)
        elif name in _VOID:
            if name == "hr":
                block += 1
            elif name != "img":
                add(" " * (name in ("br", "wbr", "input")))
        else:
            if name not in _INLINE:
                if count.get("p"):
                    close("p", ("td", "th", "li", "div", "article", "section", "blockquote"))
                block += 1
            if name in _CLOSES_LIKE:
                close(name, _CLOSES_LIKE[name])
            if name == "body":
                close("head")
            signature, words, hidden = _names(rest)
            _, path, node, (place, dropped, doubtful, article, region, outside, content) = stack[-1]
            path = xxhash.xxh64_intdigest(f"{name}.{signature}", path)
            doubt = out_ = False
            if name in ("html", "body", "main"):
                drop = hidden
            elif name == "article":
                drop = hidden or bool(words & _NEVER_ARTICLE)
            elif name == "header":
                drop = hidden or not article
            elif article or region:
                drop = hidden or name in _DROPPED or bool(words & _NEVER_ARTICLE)
                doubt = bool(words & _NAMES)
            else:
                drop = hidden or name in _DROPPED
                out_ = bool(words & _NAMES)
            if name in ("h1", "h2") and article and not hidden:
                drop = doubt = False  # titles of the article itself
            if regions and path >> 1 in regions and not hidden:
                content, drop, dropped = True, False, False
            elif content and words & _NEVER_ARTICLE:
                drop = True
            count[name] = count.get(name, 0) + 1
            flags = (
                place if name in _INLINE else path,
                dropped or drop,
                doubtful or doubt,
                article or name in ("article", "main") and not drop,
                region or bool(words & _REGION),
                outside or out_,
                content,
            )
            if node is not None and len(stack) < DEPTH:
                node.inner.append(own := Node(f"{name}.{signature}"))
                node = own
            stack.append((name, path, node, flags))
            if rest.endswith("/") and name not in ("html", "body", "p", "div", "article"):
                pop()
    return out


@dataclass
class Node:
    """An element or text of a wrapper. how: one, optional, repeated or any (optional and repeated)."""

    key: str
    how: str = "one"
    text: str | None = None  # the constant; None for elements and slots
    slot: bool = False
    signs: int = 0  # of a text, over all pages
    inner: list[Node] = field(default_factory=list)
    _shape: str | None = None

    def shape(self) -> str:
        if self._shape is None:
            self._shape = "#" if self.key == "#" else self.key + "(" + "".join(dict.fromkeys(x.shape() for x in self.inner)) + ")"
        return self._shape


_REPEATED = {"one": "repeated", "optional": "any", "repeated": "repeated", "any": "any"}
_OPTIONAL = {"one": "optional", "optional": "optional", "repeated": "any", "any": "any"}


def stream(html: str) -> Node:
    """The token stream of a page, nested; runs of equally shaped elements are one repeated group already."""
    root = Node("")
    texts(html, root=root)
    return _folded(root)


def _folded(node: Node) -> Node:
    out: list[Node] = []
    for x in node.inner:
        if x.key == "#":
            text = _clean(x.text)
            if not text:
                continue
            if out and out[-1].key == "#":  # what a comment or a break has cut in two
                out[-1].signs += len(text)
                out[-1].text = _shown(f"{out[-1].text} {text}")
            else:
                out.append(Node("#", text=_shown(text), signs=len(text)))
            continue
        x = _folded(x)
        if out and out[-1].key == x.key and (out[-1].shape() == x.shape() or x.key.startswith(("p.", "li.", "tr."))):
            out[-1] = _aligned(out[-1], x)
            out[-1].how = _REPEATED[out[-1].how]
        else:
            out.append(x)
    node.inner, node._shape = out, None
    return node


def _shown(text: str) -> str:
    return text if len(text) <= SHOWN else f"...{xxhash.xxh64_hexdigest(text)}"


def _longest(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """The longest common subsequence of keys, as places in both; of equals the one that skips in x first.

    A row of the table of lengths is a number with a bit for each place of y, 0 where the length grows. Of rows every
    isqrt(n)-th is kept, those between are made again where the way back needs them.
    """
    n, m = len(x), len(y)
    full, step = (1 << m) - 1, max(1, isqrt(n))
    at: dict[str, int] = {}
    for j, q in enumerate(y):
        at[q.key] = at.get(q.key, 0) | 1 << (m - 1 - j)

    def above(row: int, i: int) -> int:
        u = row & at.get(x[i].key, 0)
        return (row + u | row - u) & full

    def length(row: int, j: int) -> int:
        return m - j - (row & (1 << (m - j)) - 1).bit_count()

    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i].key == y[j].key:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        if i not in rows or i + 1 not in rows:
            low = i - i % step
            end = min(low + step, n)
            rows = {end: kept[end]}
            for k in range(end - 1, low - 1, -1):
                rows[k] = above(rows[k + 1], k)
        if length(rows[i + 1], j) >= length(rows[i], j + 1):
            i += 1
        else:
            j += 1
    return out


def _aligned(a: Node, b: Node) -> Node:
    """The wrapper a made to match b as well."""
    if a.key == "#":
        same = a.text == b.text and not a.slot and not b.slot
        return Node("#", a.how, a.text if same else None, not same, a.signs + b.signs)
    x, y = a.inner, b.inner
    equal = [p.key for p in x] == [q.key for q in y]
    out, i, j = [], 0, 0
    for k, m in [*(zip(range(len(x)), range(len(y)), strict=True) if equal else _longest(x, y)), (len(x), len(y))]:
        for z in (*x[i:k], *y[j:m]):
            z.how = _OPTIONAL[z.how]
            out.append(z)
        if k < len(x):
            n = _aligned(x[k], y[m])
            n.how = _HOW[x[k].how in ("optional", "any") or y[m].how in ("optional", "any"), x[k].how in ("repeated", "any") or y[m].how in ("repeated", "any")]
            out.append(n)
        i, j = k + 1, m + 1
    return Node(a.key, a.how, inner=out)


_HOW = {(False, False): "one", (True, False): "optional", (False, True): "repeated", (True, True): "any"}


def infer(pages: list[str]) -> Node | None:
    """The wrapper of some pages of one host."""
    return merged(stream(html) for html in pages)


def merged(wrappers: Iterable[Node]) -> Node | None:
    """The wrapper of several; a page's stream is a wrapper of one page."""
    out = None
    for w in wrappers:
        out = w if out is None else _aligned(out, w)
    return out


def expression(node: Node) -> str:
    """The wrapper as text: <tag>, constant text, #slot, (group)?, (group)+ and (group)*."""
    inside = "".join(map(expression, node.inner))
    own = ("#" if node.slot else node.text or "") if node.key == "#" else f"<{node.key.split('.')[0]}>{inside}" if node.key else inside
    return own if node.how == "one" else f"({own}){ {'optional': '?', 'repeated': '+', 'any': '*'}[node.how] }"


def packed(node: Node) -> list:
    return [node.key, node.how, node.text, node.slot, node.signs, [packed(x) for x in node.inner]]


def unpacked(x: list) -> Node:
    return Node(x[0], x[1], x[2], x[3], x[4], [unpacked(y) for y in x[5]])


def constants(wrapper: Node) -> list[int]:
    """Hashes of place and text of the constants that every page has, those of SHOWN signs at most."""
    out = []

    def walk(node: Node, path: int) -> None:
        for x in node.inner:
            if x.key == "#":
                if x.how == "one" and not x.slot:
                    out.append(_constant(x.text, path >> 1))
            elif x.how == "one":
                walk(x, path if x.key.split(".")[0] in _INLINE else xxhash.xxh64_intdigest(x.key, path))

    walk(wrapper, 0)
    return sorted(set(out))


def content(wrapper: Node) -> int | None:
    """The path of the element that holds most of the prose of a wrapper's slots, from the root down as long as one
    element within holds MOST of it; None if that is no more than the page's body."""

    def prose(node: Node) -> int:
        tag = node.key.split(".")[0]
        if node.key == "#":
            return node.signs if node.slot else 0
        return 0 if tag in _DROPPED or tag in ("a", "title", "header") else sum(map(prose, node.inner))

    path, at, found = 0, wrapper, None
    while True:
        whole = prose(at)
        blocks = [x for x in at.inner if x.key != "#" and x.key.split(".")[0] not in _INLINE]
        inner = max(blocks, key=prose, default=None)
        if inner is None or not whole or prose(inner) < MOST * whole:
            return found
        tag = inner.key.split(".")[0]
        if inner.how in ("repeated", "any") or tag in ("p", "li", "tr", "td", "h1", "h2"):
            return found
        path = xxhash.xxh64_intdigest(inner.key, path)
        at = inner
        if tag not in ("html", "body"):
            found = path


@dataclass
class Piece:
    """The texts of one block that have the same flags, less what is dropped."""

    block: int
    place: int
    flags: tuple[bool, bool, bool, bool, bool]  # doubtful, article, region, outside, content
    raw: str

    def __post_init__(self) -> None:
        self.place >>= 1  # as a long

    def text(self) -> str:
        return _clean(self.raw)


def pieces(html: str, regions: frozenset[int] = frozenset(), root: Node | None = None) -> list[Piece]:
    """The pieces of a page that have text, in page order."""
    out: list[Piece] = []
    kept = (t for t in texts(html, regions, root) if not t.dropped)
    for (block, *flags), group in groupby(kept, lambda t: (t.block, t.doubtful, t.article, t.region, t.outside, t.content)):
        runs = list(group)
        raw = "".join(t.raw for t in runs)
        if raw:
            out.append(Piece(block, runs[0].place, tuple(flags), raw))
    return out


def _constant(text: str, place: int) -> int:
    """The hash of a text at a place (of a Piece)."""
    return xxhash.xxh64_intdigest(text, place) >> 1


def main_text(html: str | None, furniture: frozenset[int] = frozenset(), prose: frozenset[int] = frozenset(), regions: frozenset[int] = frozenset()) -> str:
    """The article: the page's slots by its host's wrapper, blocks in page order, joined by an empty line.

    furniture: constants of the wrapper; prose: its slots of prose; regions: its content. An article or main element is
    where the slots count, else the wrapper's content, else what class words name, else the page. A class word of furniture
    within an article takes a slot out unless it is of prose; outside of articles unless it is in the content. Constants
    that are more than half of the place are its text (pages that differ outside their article only).
    """
    found = [x for x in pieces(html or "", regions) if (not x.flags[0] or x.place in prose) and (not x.flags[3] or x.flags[4] or x.flags[1])]
    own = [x.text() for x in found]
    inside = list(range(len(found)))
    for flag in (1, 4, 2):  # article, content, region
        some = [i for i in inside if found[i].flags[flag]]
        if any(own[i] for i in some):
            inside = some
            break
    else:
        flag = None
    kept = [i for i in inside if not (furniture and own[i] and _constant(own[i], found[i].place) in furniture)]
    if flag == 1 and 2 * sum(len(own[i]) for i in kept) < sum(len(own[i]) for i in inside):
        kept = inside
    blocks = []
    for _, x in groupby(kept, lambda i: found[i].block):
        of = list(x)
        blocks.append(own[of[0]] if len(of) == 1 else _clean("".join(found[i].raw for i in of)))
    return "\n\n".join(x for x in blocks if x)


def host(url) -> F.Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def aligned_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the packed wrapper of all pages(host, html) of each host, as text.

    A task aligns its own pages, host by host; then the wrappers of the tasks are aligned, TOGETHER at a time, until each
    host has one. Wrappers are of a page's size, whatever the number of pages. The order of alignment is that of the rows
    of a task and of the wrappers as text.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Node] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([json.dumps(packed(x)) for x in made.values()], pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for own, page in zip(batch.column("host"), batch.column("html"), strict=True):
                page, own = stream(page.as_py()), own.as_py()
                made[own] = _aligned(made[own], page) if own in made else page
            if len(made) > 4096:  # many small hosts
                yield rows()
                made.clear()
        if made:
            yield rows()

    def join(group: pd.DataFrame) -> pd.DataFrame:
        whole = merged(unpacked(json.loads(x)) for x in sorted(group["wrapper"]))
        return pd.DataFrame({"host": group["host"].iloc[:1].tolist(), "wrapper": [json.dumps(packed(whole))]})

    now, _ = materialise(pages.select("host", "html").mapInArrow(fold, "host string, wrapper string"))
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        part = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // TOGETHER)))
        now, _ = materialise(now.withColumn("part", part.cast("int")).groupBy("host", "part").applyInPandas(join, "host string, wrapper string"))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, furniture, prose, content): constants, slots of prose and the content of each host, as numbers with commas
    between.

    All pages count, exact copies once. A constant is a text that LEAST pages and most of those with its place have. The
    content is that of the aligned wrapper, of hosts with LEAST pages. Counts are aggregated by place and text before
    they meet, so a host with a third of all pages costs no more than another; a host's constants are at most twice the
    blocks of one page.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for own, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                h = xxhash.xxh64_intdigest(page) >> 1
                places: dict[int, list[int]] = {}
                keys: dict[int, int] = {}
                for x in pieces(page):
                    text = x.text()
                    if text:
                        n = places.setdefault(x.place, [0, 0])
                        if x.flags[0]:
                            n[0], n[1] = n[0] + 1, n[1] + len(text)
                        keys[_constant(text, x.place)] = x.place
                rows += [(own, place, 0, h, *n) for place, n in places.items()]
                rows += [(own, place, text, h, 0, 0) for text, place in keys.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "place", "text", "page", "doubtful", "signs"])

    own = pages.where(F.length(html) > 0).select(host(F.col(url)).alias("host"), F.col(html).alias("html"))
    rows = own.mapInArrow(count, "host string, place long, text long, page long, doubtful long, signs long")
    # text 0 is the place itself
    rows = rows.groupBy("host", "place", "text", "page").agg(F.max("doubtful").alias("doubtful"), F.max("signs").alias("signs"))
    counts = rows.groupBy("host", "place", "text").agg(F.count("*").alias("n"), F.sum("doubtful").alias("doubtful"), F.sum("signs").alias("signs"))
    counts = materialise(counts.where(F.col("n") >= LEAST))[0]
    places = counts.where("text = 0").select("host", "place", F.col("n").alias("__n"))
    none = F.lit(None).cast("long")
    constant = counts.where("text <> 0").join(places, ["host", "place"]).where(2 * F.col("n") > F.col("__n")).select("host", F.col("text").alias("constant"), none.alias("slot"), none.alias("region"))
    slots = counts.where((F.col("text") == 0) & (F.col("doubtful") > 0) & (F.col("signs") >= PROSE * F.col("doubtful"))).select("host", none.alias("constant"), F.col("place").alias("slot"), none.alias("region"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content(unpacked(json.loads(x))) for x in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([None if x is None else x >> 1 for x in found], pa.int64())], names=["host", "region"])

    # hosts of which LEAST pages have a place in common
    known = counts.select("host").distinct()
    regions = aligned_wrappers(own).mapInArrow(find, "host string, region long").where("region is not null").join(known, "host", "left_semi")
    regions = regions.select("host", none.alias("constant"), none.alias("slot"), "region")
    listed = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)).cast("array<string>"))
    return constant.unionByName(slots).unionByName(regions).groupBy("host").agg(listed("constant").alias("furniture"), listed("slot").alias("prose"), listed("region").alias("content"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of pages (all, if not given) and main: the article of every whole page.

    Null and empty pages and pages without text have an empty main; pages without a host share one wrapper; repeated
    rows get the same text each, and count once for constants; an input column named main is replaced. Of elements that
    hold equally much prose the first is the content; a text on just half of the pages that have its place is no constant.
    Pages of any length are read whole; elements below the DEPTH-th are one with it in the wrapper.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c != "main"]
    own, page, joined = (own_name(n, keep) for n in ("__host", "__html", "__wrapper"))
    known = materialise(wrappers(pages, url, html).select(F.col("host").alias(own), F.concat_ws(";", "furniture", "prose", "content").alias(joined)))[0]
    known = sized(known, F.length(own) + F.length(joined) + 64)
    rows = pages.select(*keep, F.col(html).alias(page), host(F.col(url)).alias(own)).join(known, own, "left").drop(own)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: tuple[frozenset[int], ...] = (frozenset(), frozenset(), frozenset())
        seen: dict[str | None, tuple[frozenset[int], ...]] = {None: none}
        for batch in batches:
            found = []
            for html_, wrapper in zip(batch.column(page).to_pylist(), batch.column(joined).to_pylist(), strict=True):
                if wrapper not in seen:
                    if len(seen) > 256:
                        seen = {None: none}
                    seen[wrapper] = tuple(frozenset(map(int, filter(None, x.split(",")))) for x in wrapper.split(";"))
                found.append(main_text(html_, *seen[wrapper]))
            kept = batch.drop_columns([page, joined])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], names=[*kept.schema.names, "main"])

    return rows.mapInArrow(find, T.StructType([f for f in rows.schema.fields if f.name not in (page, joined)]).add("main", "string"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), keep=["page_id", "url"])
    return out.select("page_id", "url", F.col("main").alias("text"), F.char_length("main").cast("long").alias("n_chars"))
