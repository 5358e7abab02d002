"""Main text of web pages by a minimum cut over the page's text blocks.

A page is cut into blocks at block-level tags.  A logistic regression over features of a block (its length,
its share of link text, its tag, what the elements around it say by tag, class, id and role) gives the
log-odds of content; these are the capacities of its edges to source and sink.  Neighbours in page order
are tied by smoothness edges that get weaker with their distance in the tree, and so are blocks of one
container that others stand between.  The maximum flow separates the two sides at least cost, so that a
block which by itself looks like the other side goes with those around it.  All capacities are finite.

The regression is trained on pages that ``training_pages`` makes up: articles in many kinds of containers
between menus, notices, adverts, comments and the like, with and without telling names.

Ties of neighbours and siblings never cross, so a block with at most two ties can always be found; it is
replaced with the flow that it lets through, and the whole network goes in linear time.

Pages are handled one by one inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import small_batches

#: Tags that end a block.  Fixed values of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What HTML reads as raw text: skipped up to its end tag.
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
#: Elements whose text is not the page's own; a block that begins within one of PHRASES ends it, others may hold blocks.
PHRASES = frozenset("button select svg math".split())
EMBEDDED = PHRASES | frozenset("object canvas audio video template".split())
#: An open one of these ends where the next begins.
ITEM_TAGS = frozenset("p li dd dt tr td th option".split())
#: Tags that hold one run of text; a name on them says less than one on a container.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt span a b i em strong td th".split())
#: Elements that are hardly ever part of an article.
BOILER_TAGS = frozenset("nav aside footer form menu dialog search head fieldset".split())
#: Words of class, id and role by which sites name what is not the article: surely, and maybe.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion replies sidebar signup sponsor sponsored subscribe subscription toolbar topbar".split()
)
MAYBE_WORDS = frozenset("dialog recommended related reply search share sharing social tags widget widgets".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: With one of these, a name tells of the layout and not of what the element is.
LAYOUT_WORDS = frozenset("has layout no with without".split())
#: Headings after which the rest of their container is not the article.
AFTER = re.compile(
    r"^\W*(?:(?:\d+ )?(?:(?:reader|user) )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?: ?\(?\d*\)?)?\W*$"
    r"|(?:leave|post|write|add) a (?:comment|reply)\b|(?:related|recommended|more|popular|latest) (?:articles|posts|stories|news)\W*$|(?:you may also like|advertisement|sponsored)\W*$)",
    re.I,
)

#: Comments, declarations and tags.  A quote has a meaning behind = alone, and only if it is closed, so that every value ends where it should however long it is.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW_TAGS}
_WORDS = re.compile(r"[a-z]+")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("bias", "length", "links", "sentence", "heading", "paragraph", "item", "article", "boiler", "maybe", "bare")


@dataclass(frozen=True)
class Model:
    """Weights of the classifier (log-odds of content) by feature, and of the smoothness edges."""

    weights: tuple[float, ...]
    neighbour: float = 4.0
    siblings: float = 3.0
    apart: float = 0.5


class _Element:
    """An open element: what it and those around it say."""

    __slots__ = ("tag", "number", "up", "depth", "article", "boiler", "maybe", "after")

    def __init__(self, tag: str, number: int, up: _Element | None, attributes: str):
        self.tag, self.number, self.up, self.after = tag, number, up.number if up else 0, 0
        self.depth = up.depth + 1 if up else 0
        self.article, self.boiler, self.maybe = (up.article, up.boiler, up.maybe) if up else (False, False, False)
        if up and up.after:
            if tag in _LEVELS and _LEVELS[tag] <= up.after:
                up.after = 0
            else:
                self.boiler = True
        if tag == "main":
            self.article, self.boiler = True, False
        elif tag == "article":
            self.article = True
        elif tag in BOILER_TAGS or tag in EMBEDDED or tag == "header" and not self.article:
            self.boiler = True
        if attributes:
            self._read(tag, attributes)

    def _read(self, tag: str, attributes: str) -> None:
        words: set[str] = set()
        for name, value in _ATTR.findall(attributes):
            name = name.lower()
            if name == "hidden" or name == "style" and _HIDDEN.search(value):
                self.boiler = True
            elif name in ("class", "id", "role", "itemprop"):
                words.update(_WORDS.findall(_SPLIT_CAMEL.sub(" ", value).lower()))
        if not words or tag in ("html", "body", "article", "main"):
            return
        named = not words.isdisjoint(ARTICLE_WORDS)
        if not words.isdisjoint(BOILER_WORDS) and words.isdisjoint(LAYOUT_WORDS):
            if tag in TEXT_TAGS:
                self.maybe = True
            else:
                self.boiler = True
        elif named:
            self.article = True
        elif not words.isdisjoint(MAYBE_WORDS) and tag not in TEXT_TAGS:
            self.maybe = True


_LEVELS = {f"h{i}": i for i in range(1, 7)}


@dataclass
class Block:
    """Text of a block, where it is (container, depth, how far up the way from the block before leads) and what the classifier reads."""

    text: str
    parent: int
    depth: int
    top: int
    linked: int
    tag: str
    article: bool
    boiler: bool
    maybe: bool


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order.  Unclosed and misnested tags are tolerated: an end tag closes up to its start.

    Takes time in proportion to the page: open elements are found by their tag.
    """
    root = _Element("", 0, None, "")
    stack, blocks = [root], [0]  # open elements; places of block-level ones
    places: dict[str, list[int]] = {}  # places by tag
    out: list[Block] = []
    buffer: list[str] = []
    linked = number = 0
    low = 0  # depth of the highest element since the last block
    at, end = 0, len(html)
    embedded = 0  # open elements of EMBEDDED
    last_end: dict[str, int] = {}  # where the last end tag of an element of EMBEDDED is

    def flush() -> None:
        nonlocal linked, low
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            if text:
                e = stack[blocks[-1]]
                boiler = e.boiler or bool(e.after)
                level = _LEVELS.get(e.tag, 0)
                if level > 1 and AFTER.match(text):
                    boiler = True
                    if blocks[-1] > 0:
                        stack[blocks[-1] - 1].after = level
                out.append(Block(text, e.up, e.depth, min(low, e.depth), min(linked, len(text)), e.tag, e.article, boiler, e.maybe))
                low = e.depth
            buffer.clear()
        linked = 0

    def close(i: int) -> None:
        """Ends all elements from place i on."""
        nonlocal low, embedded
        for e in stack[i:]:
            if e.tag:
                places[e.tag].pop()
                embedded -= e.tag in EMBEDDED
        del stack[i:]
        while blocks[-1] >= i:
            blocks.pop()
        low = min(low, stack[-1].depth)

    while at < end:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        # what stands in an embedded element itself is no part of the block around it
        if text and not (embedded and any(places[t][-1] > blocks[-1] for t in EMBEDDED if places.get(t))):
            buffer.append(text)
            if places.get("a"):
                linked += len(text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if closing:
            if block:
                flush()
            if places.get(tag):
                i = places[tag][-1]
                if block or blocks[-1] < i:
                    close(i)
                else:  # an inline end tag does not close blocks that stand open inside it
                    places[tag].pop()
                    stack[i].tag = ""
                    embedded -= tag in EMBEDDED
            continue
        if tag in RAW_TAGS:
            if block and not embedded:  # the title of a drawing ends nothing
                flush()
            if not _CLOSED.search(attributes):
                found = _RAW_END[tag].search(html, at)
                at = found.end() if found else end
            continue
        if block:
            flush()
            if embedded and tag != "option":
                inside = [places[t][0] for t in PHRASES if places.get(t)]
                if inside:
                    close(min(inside))
            if tag in ITEM_TAGS and stack[blocks[-1]].tag == tag:
                close(blocks[-1])
        if tag in EMBEDDED:
            if tag not in last_end:
                last_end[tag] = max((e.start() for e in re.finditer(rf"</{tag}(?=[\s/>])", html, re.I)), default=-1)
            if at > last_end[tag]:  # it is never closed: what follows is the page's
                continue
            if tag == "button" and places.get(tag):
                close(places[tag][-1])
            embedded += not _CLOSED.search(attributes)
        if tag in VOID_TAGS or _CLOSED.search(attributes):
            continue
        number += 1
        places.setdefault(tag, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append(_Element(tag, number, stack[-1], attributes))
    flush()
    return out


def is_bare(found: list[Block]) -> bool:
    """Nothing on the page tells an article or its surroundings."""
    return not any(b.article or b.boiler for b in found)


def features(b: Block, bare: bool) -> tuple[float, ...]:
    """What the classifier reads of a block, in the order of FEATURES."""
    n = len(b.text)
    return (1.0, min(log1p(n / 20), 3.0), b.linked / n, float(bool(_SENTENCE.search(b.text))), float(b.tag in _LEVELS), float(b.tag in ("p", "blockquote", "pre")), float(b.tag in ("li", "dd", "dt", "td", "th")), float(b.article and not b.boiler), float(b.boiler), float(b.maybe), float(bare and b.tag != ""))


def cost(b: Block, w: Model, bare: bool) -> float:
    """Log-odds of content."""
    return sum(x * y for x, y in zip(features(b, bare), w.weights, strict=True))


# -- training -------------------------------------------------------------------------------------


def _page(rnd: random.Random) -> tuple[str, dict[str, bool]]:
    """A made-up page, and for the text of each of its blocks whether it is content."""
    label: dict[str, bool] = {}

    def words(n: int) -> str:
        return " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(n))

    def text(content: bool, lo: int, hi: int, stop: float) -> str:
        t = words(rnd.randint(lo, hi)) + ("." if rnd.random() < stop else "")
        label[t] = content
        return t

    def some(p: float, make) -> str:
        return make() if rnd.random() < p else ""

    def many(lo: int, hi: int, make) -> str:
        return "".join(make() for _ in range(rnd.randint(lo, hi)))

    def named(tag: str, inside: str, *names: str) -> str:
        name = rnd.choice((*names, ""))
        attribute = f" {rnd.choice(('class', 'id'))}='{name}'" if name else ""
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def link(content: bool) -> str:
        return f"<li><a href=/>{text(content, 1, 4, 0)}</a></li>"

    def fragment(content: bool) -> str:
        """A short block that by itself may be either."""
        return rnd.choice((
            lambda: f"<div>{text(content, 1, 5, 0.2)}</div>",
            lambda: f"<p>{text(content, 1, 5, 0.2)}</p>",
            lambda: f"<p><a href=/>{text(content, 1, 5, 0.1)}</a></p>",
            lambda: f"<div><span>{text(content, 2, 8, 0.4)}</span></div>",
        ))()

    def loose() -> str:
        """Boilerplate that nothing around it tells."""
        return f"<div>{many(2, 5, lambda: fragment(False))}</div>"

    def linked() -> str:
        a, b = words(rnd.randint(1, 25)), words(rnd.randint(1, 8))
        label[f"{a} {b}."] = True
        return f"<p>{a} <a href=/>{b}</a>.</p>"

    def paragraph(content: bool = True) -> str:
        if content and rnd.random() < 0.15:
            return linked()
        tag = rnd.choice("ppppp") if rnd.random() < 0.85 else rnd.choice(("blockquote", "div", "pre"))
        return f"<{tag}>{text(content, *rnd.choice(((1, 6), (6, 30), (30, 120))), 0.9)}</{tag}>"

    def inside() -> str:
        return rnd.choice((
            lambda: named("div", many(2, 4, lambda: link(False)), "share", "social", "tags"),
            lambda: f"<div class='{rnd.choice(('ad', 'advert', 'sponsored', 'newsletter-signup', 'notice'))}'>{paragraph(False)}</div>",
            lambda: named("ul", many(2, 5, lambda: link(False)), "related", "recommended"),
        ))()

    def article() -> str:
        parts = [f"<h1>{text(True, 2, 12, 0.3)}</h1>", *(paragraph() for _ in range(rnd.randint(1, 9)))]
        parts.insert(rnd.randint(1, len(parts)), some(0.4, lambda: f"<ul>{many(2, 5, lambda: f'<li>{text(True, 2, 20, 0.5)}</li>')}</ul>"))
        parts.insert(rnd.randint(1, len(parts)), some(0.4, lambda: f"<h2>{text(True, 1, 6, 0.1)}</h2>{paragraph()}"))
        parts.insert(rnd.randint(1, len(parts)), some(0.2, lambda: f"<ul>{many(2, 5, lambda: link(True))}</ul>"))
        parts.insert(rnd.randint(1, len(parts)), some(0.3, inside))
        parts.insert(rnd.randint(1, len(parts)), some(0.1, loose))
        for _ in range(rnd.randint(0, 3)):
            parts.insert(rnd.randint(1, len(parts)), fragment(True))
        body = "".join(parts)
        return rnd.choice((f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>", f"<div id=content>{body}</div>", f"<div class='post-body'>{body}</div>", f"<div class=x{rnd.randint(1, 9)}>{body}</div>", f"<section><div>{body}</div></section>", body))

    def comments() -> str:
        one = lambda: rnd.choice((f"<div class='comment'>{paragraph(False)}</div>", f"<article class='comment'>{paragraph(False)}</article>"))
        return f"<section class='{rnd.choice(('comments', 'reader-comments', 'disqus'))}'>{many(1, 6, one)}</section>"

    menu = lambda: rnd.choice((f"<nav><ul>{many(3, 7, lambda: link(False))}</ul></nav>", named("div", f"<ul>{many(3, 7, lambda: link(False))}</ul>", "menu", "navbar")))
    notice = lambda: f"<div class='{rnd.choice(('cookie-notice', 'ad', 'banner', 'promo', 'advert', 'breadcrumb'))}'>{paragraph(False)}</div>"
    foot = lambda: rnd.choice((f"<footer>{text(False, 3, 20, 0.7)}</footer>", f"<div class=footer>{paragraph(False)}</div>"))
    side = lambda: rnd.choice((f"<aside>{paragraph(False)}{many(2, 4, lambda: link(False))}</aside>", f"<div class=sidebar><h3>{text(False, 1, 3, 0)}</h3>{many(2, 4, lambda: link(False))}{paragraph(False)}</div>"))
    form = lambda: f"<form><p>{text(False, 2, 12, 0.7)}</p></form>"
    head = lambda: f"<header><h1>{text(False, 1, 3, 0)}</h1></header>"
    if rnd.random() < 0.2:  # a bare page
        return (many(1, 4, paragraph) if rnd.random() < 0.8 else loose()), label
    return "<html><body>" + some(0.5, head) + menu() + some(0.5, loose) + some(0.6, notice) + some(0.3, side) + article() + some(0.5, loose) + some(0.5, comments) + some(0.4, side) + some(0.3, form) + some(0.9, foot) + "</body></html>", label


def training_pages(n: int, seed: int = 1) -> Iterator[tuple[list[Block], list[bool]]]:
    """Blocks and labels of n made-up pages."""
    rnd = random.Random(seed)
    for _ in range(n):
        html, label = _page(rnd)
        found = blocks_of(html)
        yield found, [label[b.text] for b in found]


@lru_cache
def trained(pages: int = 400, seed: int = 1, ridge: float = 1.0) -> Model:
    """The model fitted by Newton's method on blocks of made-up pages; the same at every call."""
    blocks = [(features(b, is_bare(found)), y) for found, labels in training_pages(pages, seed) for b, y in zip(found, labels, strict=True)]
    x, y = np.array([f for f, _ in blocks]), np.array([v for _, v in blocks], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
    return Model(tuple(float(v) for v in w))


# -- the cut --------------------------------------------------------------------------------------


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) at least cost.

    Calling i boilerplate costs max(score, 0), content max(-score, 0); an edge (i, j, c) costs c where the
    labels differ.  A vertex with one or two edges is taken out with the flow that passes through it: what it
    can send to or take from its neighbours moves to their terminals, and what two neighbours can exchange
    through it becomes an edge between them.  That keeps the least cost for all labels of the others.  What
    is left when no such vertex is (nothing, on the ties of a page) is solved by augmenting paths.
    """
    n = len(scores)
    bound = 1.0 + sum(c for *_, c in edges) + sum(abs(s) for s in scores if abs(s) != float("inf"))
    h = [min(max(s, -bound), bound) for s in scores]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    out, order = [False] * n, []
    todo = [i for i in range(n) if len(near[i]) <= 2]
    while todo:
        v = todo.pop()
        if out[v] or len(near[v]) > 2:
            continue
        out[v] = True
        ties = list(near[v].items())
        order.append((v, ties))
        for i, _ in ties:
            del near[i][v]
        if len(ties) == 1:
            (a, c) = ties[0]
            h[a] += min(max(h[v], -c), c)
        elif ties:
            (a, ca), (b, cb) = ties
            # least cost at v by the labels of a and b (0: boilerplate)
            c00, c01, c10, c11 = min(ca + cb, h[v]), min(ca, h[v] + cb), min(cb, h[v] + ca), min(0.0, h[v] + ca + cb)
            h[a] += (c00 + c01 - c10 - c11) / 2
            h[b] += (c00 + c10 - c01 - c11) / 2
            through = (c01 + c10 - c00 - c11) / 2
            if through > 0:
                near[a][b] = near[a].get(b, 0.0) + through
                near[b][a] = near[b].get(a, 0.0) + through
        todo += [i for i, _ in ties]
    rest = [i for i in range(n) if not out[i]]
    label = _augmented(rest, h, near)
    for v, ties in reversed(order):
        boiler, content = h[v], 0.0
        for i, c in ties:
            if label[i]:
                boiler += c
            else:
                content += c
        label[v] = boiler > content
    return [label[i] for i in range(n)]


def _augmented(vertices: list[int], h: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Labels by flow along shortest augmenting paths; the source side is what can still be reached."""
    source, sink = {i: max(h[i], 0.0) for i in vertices}, {i: max(-h[i], 0.0) for i in vertices}
    eps = 1e-12
    while True:
        came = {i: -1 for i in vertices if source[i] > eps}
        queue, last = deque(came), -1
        while queue:
            i = queue.popleft()
            if sink[i] > eps:
                last = i
                break
            for j, c in near[i].items():
                if c > eps and j not in came:
                    came[j] = i
                    queue.append(j)
        if last < 0:
            return {i: i in came for i in vertices}
        path = [last]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        first = path[-1]
        flow = min(source[first], sink[last], *(near[path[k + 1]][path[k]] for k in range(len(path) - 1)))
        source[first] -= flow
        sink[last] -= flow
        for k in range(len(path) - 1):
            near[path[k + 1]][path[k]] -= flow
            near[path[k]][path[k + 1]] += flow


def labelled(html: str | None, model: Model) -> list[tuple[Block, float, bool]]:
    """(block, log-odds of content, whether the cut keeps it) of a page."""
    found = blocks_of(html or "")
    bare = is_bare(found)
    scores = [cost(b, model, bare) for b in found]
    edges = []
    by_parent: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            steps = max(found[i - 1].depth, b.depth) - b.top
            edges.append((i - 1, i, model.neighbour / (1.0 + model.apart * steps)))
        if by_parent.get(b.parent, i - 1) != i - 1:
            edges.append((by_parent[b.parent], i, model.siblings))
        by_parent[b.parent] = i
    return list(zip(found, scores, min_cut(scores, edges), strict=True))


def extract(html: str | None, model: Model | None = None) -> str:
    """Main text of a page, blocks joined by a line end; empty if there is none."""
    return "\n".join(b.text for b, _, keep in labelled(html, model or trained()) if keep)


def extract_text(pages: DataFrame, *, html: str = "html", model: Model | None = None) -> DataFrame:
    """pages without html, with text and n_chars (code points) appended; columns of those names are replaced.

    A null or empty html has an empty text.  Repeated rows are handled one by one; an empty table gives
    an empty one.
    """
    small_batches(pages.sparkSession)
    model = model or trained()
    keep = [c for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    src = pages.select(*keep, F.col(html).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, model) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages with its main text; nulls, empties, repeats and empty tables as extract_text has them."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
