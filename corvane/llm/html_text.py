"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a list of text blocks with their places in the element tree. A classifier
gives each block a cost of being called content and a cost of being called boilerplate;
these are the capacities to the two terminals. Neighbouring blocks, and blocks with the same
parent, are joined by edges whose capacity falls with their distance in the tree. The
minimum cut between the terminals is the cheapest labelling.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import small_batches

# Elements by what they do to a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: MathML; its text runs in the line.
MATH = frozenset(
    "math annotation annotation-xml maction maligngroup malignmark menclose merror mfenced mfrac mglyph mi mlabeledtr "
    "mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd "
    "mtext mtr munder munderover none semantics".split()
)
SPACED = frozenset("br mspace mtd mtr mlabeledtr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object noframes noembed xmp select".split())
#: HTML leaves an svg at these tags, except inside the elements of the second kind.
LEAVES_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HTML_IN_SVG = frozenset("foreignobject desc title".split())
#: Never part of an article.
BANNED = frozenset("nav footer aside form head dialog menu button fieldset".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "p": ("p",),
}
BARRIER = frozenset("ul ol dl table div section article aside nav header footer main body form blockquote".split())
MAIN = frozenset("article main".split())
MAIN_NAMES = frozenset("article content post entry story main body text articlebody maincontent postbody hentry".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion "
    "promoted nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar "
    "side aside widget widgets related recommended recommendations popular trending share sharing social follow cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login register comment comments commentlist disqus replies reply discussion respond pagination pager tags tagcloud "
    "copyright legal disclaimer search searchform hidden skip toolbar".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())

#: Inside an article these are taken at their word; the other bad names may be those of its sections.
FIRM_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promoted nav navbar breadcrumb "
    "breadcrumbs sidebar widget widgets share sharing social cookie cookies consent gdpr popup modal newsletter subscribe subscription "
    "signup login comments commentlist disqus replies respond pagination pager".split()
)
#: Names of what readers wrote.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
#: Words beside a bad one that leave its meaning, as numbers do.
HELPERS = frozenset(
    "box slot container wrapper wrap list area section block unit button buttons link links bar panel form inner outer top bottom left "
    "right item items post posts article articles stories site page main content js row col text title user users reader readers visitor "
    "thread holder google sticky floating mobile desktop icon icons count counter zone placeholder".split()
)
#: Tags of running text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\"']*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_MARKUP = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*+)")
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([a-zA-Z][-\w:]*)", re.S)
_LAST = re.compile(r"[^\s\"'>]*")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ABOUT = re.compile(r"(?i)(?:has|with|no|without|hide|show)[-_]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Tags:
    """Tags of a page by place, in time linear in the page, however broken it is.

    What begins like a tag but never ends, for a quote in it stays open, is text. Once there is
    such a one, ends are found from a list of the places of '>' and quotes: an end that is known not to
    exist from some place on isn't looked for from there again.
    """

    def __init__(self, page: str):
        self.page = page
        self.special: list[int] | None = None
        self.endless: set[int] = set()  # numbers of special places from which, outside quotes, no tag ends

    def after(self, pos: int) -> tuple[int, int, bool, str | None, str] | None:
        """The first tag at or after ``pos``: start, end, whether it closes, name in lower case (none for a comment), attributes."""
        page = self.page
        while (at := page.find("<", pos)) >= 0:
            if not _MARKUP.match(page, at):
                pos = at + 1
                continue
            if self.special is None or page[at + 1] in "!?":
                m = _TAG.match(page, at)
                if m:
                    return at, m.end(), bool(m[1]), m[2] and m[2].lower(), m[3] or ""
                self.special = [m.start() for m in _SPECIAL.finditer(page, at)]
            end = self._end(at)
            if end < 0:
                pos = at + 1
                continue
            m = _NAME.match(page, at, end)
            return at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
        return None

    def _end(self, at: int) -> int:
        special, seen = self.special, []
        k = bisect_left(special, at)
        while k < len(special) and k not in self.endless:
            c = self.page[special[k]]
            if c == ">":
                return special[k]
            seen.append(k)
            k += 1
            while k < len(special) and self.page[special[k]] != c:
                k += 1
            k += 1
        self.endless.update(seen)
        return -1


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    banned: bool = False
    bad: bool = False
    main: bool = False
    suspect: bool = False  # bad if it is mostly links
    in_form: bool = False  # banned for nothing but a form
    scope: Element | None = None  # the nearest element that no implied end tag crosses
    held: Counter | None = None  # open elements of this scope by tag
    attrs: str = ""
    mass: int = 0  # characters of running text in it


@dataclass
class Block:
    at: Element
    text: str
    linked: int = 0  # characters inside links


def _names(value: str) -> Iterator[list[str]]:
    """The parts of each class or id."""
    for name in value.split():
        if not _ABOUT.match(name):  # says what else is on the page, not what this is
            yield [x for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if x]


def _judge(e: Element, tag: str, named: list[tuple[str, list[str]]], in_article: bool) -> None:
    """What classes and ids say of an element. In an article, whose sections have names of their own, only
    a whole name counts, and one that may be a section's only with links for evidence."""
    every = {x for _, parts in named for x in parts}
    if not in_article:
        if every & BAD_NAMES and tag not in ("body", "html"):
            e.bad = not (every & MAIN_NAMES and tag in MAIN)
        elif every & MAIN_NAMES and not e.bad:
            e.main = True
        return
    for attr, parts in named:
        if not BAD_NAMES.intersection(parts) or any(p not in BAD_NAMES and p not in HELPERS and p.isalpha() for p in parts):
            continue
        firm = not FIRM_NAMES.isdisjoint(parts)
        if tag in TEXTUAL:
            sure = firm and attr == "class"
        elif tag == "section":
            sure = firm
        else:
            sure = firm or attr == "class"
        e.bad |= sure
        e.suspect |= not sure


@dataclass
class _Said:
    """What an element's attributes say."""

    named: list[tuple[str, list[str]]]
    role: str
    hidden: bool
    readers: bool  # it holds readers' comments


def _said(e: Element) -> _Said:
    out = _Said([], "", False, False)
    if e.attrs.strip(" /\t\r\n"):
        for k, v, bare in _ATTR.findall(e.attrs):
            k = (k or bare).lower()
            v = v.strip("\"'")
            if k in ("class", "id"):
                out.named += [(k, parts) for parts in _names(v)]
            elif k == "role":
                out.role = v.lower()
            elif k == "hidden" or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)):
                out.hidden = True
        out.readers = any(COMMENT_NAMES.intersection(parts) for _, parts in out.named)
    return out


#: Words that make the name of a wrapper of one with a bad word in it.
WRAPPED = frozenset("content page main site body layout post article story entry".split())


def _wraps(x: _Said) -> bool:
    """Whether an element's names, where they have a bad word, say something of the page besides."""
    bad = [parts for _, parts in x.named if BAD_NAMES.intersection(parts)]
    return all(any(p in WRAPPED or (p not in BAD_NAMES and p not in HELPERS and p.isalpha()) for p in parts) for parts in bad)


def _spared(elements: list[Element], said: list[_Said], blocks: list[Block]) -> set[int]:
    """Numbers of elements that no name and no form makes boilerplate, for they hold the page's text.

    That are the elements around the largest article that isn't a reader's comment, if it holds a quarter of the page's running text,
    or else those around ``main``, and inside of either those with most of its text whose names aren't those of a box alone; on a page with neither, those with most of
    the page's text. What readers wrote is never spared.
    """
    number = {id(e): i for i, e in enumerate(elements)}
    shut = [e.tag in BANNED - {"form", "fieldset"} or x.hidden or x.role in BAD_ROLES for e, x in zip(elements, said, strict=True)]
    readers = [x.readers for x in said]
    for i, e in enumerate(elements):  # parents come first
        if e.parent is not None:
            readers[i] |= readers[number[id(e.parent)]]
    for b in blocks:
        if b.linked * 2 < len(b.text):
            b.at.mass += len(b.text)
    for i in range(len(elements) - 1, 0, -1):
        if shut[i]:
            elements[i].mass = 0
        elements[i].parent.mass += elements[i].mass
    total = elements[0].mass
    articles = [i for i, e in enumerate(elements) if (e.tag == "article" or said[i].role == "article") and not readers[i] and 4 * e.mass >= max(total, 1)]
    mains = [i for i, e in enumerate(elements) if (e.tag == "main" or said[i].role == "main") and e.mass]
    out: set[int] = set()
    if not articles and not mains:
        return {i for i, e in enumerate(elements) if 2 * e.mass > total and not readers[i]}
    top = max(articles or mains, key=lambda i: (elements[i].mass, i))
    inside = [False] * len(elements)
    for i in range(top, len(elements)):
        e = elements[i]
        inside[i] = i == top or (e.parent is not None and inside[number[id(e.parent)]])
        if inside[i] and 2 * e.mass > elements[top].mass and not readers[i] and e.tag != "form" and _wraps(said[i]):
            out.add(i)
    e = elements[top]
    while e is not None:
        out.add(number[id(e)])
        e = e.parent
    return out


def _settle(elements: list[Element], blocks: list[Block]) -> None:
    """Labels of the elements by their tags, names and roles, parents first."""
    said = [_said(e) for e in elements]
    names = any(x.named for x in said) or any(e.tag in ("form", "fieldset") for e in elements)
    spared = _spared(elements, said, blocks) if names else set()
    for i, (e, x) in enumerate(zip(elements, said, strict=True)):
        parent, tag = e.parent, e.tag
        if parent:
            e.banned, e.bad, e.main, e.suspect, e.in_form = parent.banned, parent.bad, parent.main, parent.suspect, parent.in_form
        in_article = e.main
        if tag in MAIN and e.in_form:  # a form around a whole page
            e.banned = e.in_form = False
        if tag == "form" and not e.banned:
            e.banned = e.in_form = i not in spared
        elif tag == "fieldset" and not e.in_form and (in_article or i in spared):
            pass  # a box in an article
        elif tag in BANNED or (tag == "header" and not in_article):
            e.banned, e.in_form = True, False
        if x.role in BAD_ROLES or x.hidden:
            e.banned, e.in_form = True, False
        e.main |= tag in MAIN or x.role in ("main", "article")
        if x.named and i not in spared:
            _judge(e, tag, x.named, in_article)
        elif x.named and not in_article and not any(BAD_NAMES.intersection(parts) for _, parts in x.named):
            e.main |= any(MAIN_NAMES.intersection(parts) for _, parts in x.named)


def _empty(attrs: str) -> bool:
    """Whether a tag of foreign content closes itself. A '/' that ends an unquoted value belongs to the value."""
    if not attrs.endswith("/"):
        return False
    last = _LAST.match(attrs[::-1])[0]
    return "=" not in last and not attrs[: len(attrs) - len(last)].rstrip().endswith("=")


def _svg_end(tags: Tags, pos: int) -> int:
    """Where the svg opened before ``pos`` ends: after its closing tag, or where HTML leaves it without one."""
    inside, held = ["svg"], Counter(["svg"])
    while t := tags.after(pos):
        start, pos, closing, tag, attrs = t
        if tag is None:
            continue
        if closing and held[tag]:
            while True:
                last = inside.pop()
                held[last] -= 1
                if last == tag:
                    break
            if not inside:
                return pos
        elif closing or tag in LEAVES_SVG:
            if not any(held[x] for x in HTML_IN_SVG):
                return start
            if not closing and tag not in VOID:
                inside.append(tag)
                held[tag] += 1
        elif tag not in VOID and not _empty(attrs):
            inside.append(tag)
            held[tag] += 1
    return len(tags.page)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order. Text between two block-level tags is one block."""
    root = top = Element("#", None, 0)
    root.scope, root.held = root, Counter()
    opened: Counter[str] = Counter()
    tags = Tags(page)
    out: list[Block] = []
    elements = [root]
    parts: list[str] = []
    linked = links = 0
    pos = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(top, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def push(e: Element) -> None:
        nonlocal top
        opened[e.tag] += 1
        e.scope = top.scope
        e.scope.held[e.tag] += 1
        if e.tag in BARRIER:
            e.scope, e.held = e, Counter()
        top = e

    def pop_to(e: Element) -> None:
        nonlocal top
        flush()
        while True:
            opened[top.tag] -= 1
            top.parent.scope.held[top.tag] -= 1
            last, top = top, top.parent
            if last is e:
                break

    end = len(page)
    while pos < end:
        t = tags.after(pos)
        stop = t[0] if t else end
        if stop > pos:
            piece = page[pos:stop]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not t:
            break
        _, pos, closing, tag, attrs = t
        if tag is None:
            continue
        if tag in RAW:
            if closing:
                continue
            if tag == "svg":
                if not _empty(attrs):
                    pos = _svg_end(tags, pos)
            else:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else end
            continue
        if tag in INLINE or tag in MATH:
            if tag in SPACED:
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            links = 0
            if opened[tag]:
                e = top
                while e.tag != tag:
                    e = e.parent
                pop_to(e)
            continue
        if tag in VOID:
            continue
        for other in CLOSES.get(tag, ()):
            if top.scope.held[other]:
                e = top
                while e.tag != other:
                    e = e.parent
                pop_to(e)
        if top.tag == "p":  # a block-level tag ends a paragraph
            pop_to(top)
        push(Element(tag, top, top.depth + 1, attrs=attrs))
        elements.append(top)
    flush()
    _settle(elements, out)
    return out


#: A cost that no smoothing outweighs.
FIRM = 1e6


def costs(b: Block, has_main: bool) -> tuple[float, float]:
    """Cost of calling a block content, and of calling it boilerplate."""
    e = b.at
    if e.banned:
        return FIRM, 0.0
    x = -0.4
    x += 5.0 if e.main else (-2.5 if has_main else 0.0)
    density = b.linked / len(b.text)
    if e.bad or (e.suspect and density > 0.5):
        x -= 9.0
    x -= 3.0 * density if not e.main else 1.0 * density
    words = b.text.count(" ") + 1
    x += min(3.0, math.log2(1 + words / 6)) if density < 0.5 else 0.0
    if e.tag in ("p", "h1", "blockquote", "pre"):
        x += 1.2
    elif e.tag in ("h2", "h3", "h4", "h5", "h6", "figcaption"):
        x += 0.3
    elif e.tag in ("li", "td", "th", "dd", "dt"):
        x -= 0.3
    if "©" in b.text or b.text.lower().startswith("copyright"):
        x -= 3.0
    # logistic costs: -log of the probability of the other label
    return _softplus(-x), _softplus(x)


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        else:
            break
        n += 1
    return n


def edges_of(blocks: list[Block], weight: float = 1.6) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next, and to the next one with the same parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, weight / (1 + distance(blocks[i - 1].at, b.at))))
        parent = id(b.at.parent or b.at)
        j = last.get(parent)
        if j is not None and j < i - 1:
            out.append((j, i, weight / (1 + distance(blocks[j].at, b.at)) / 2))
        last[parent] = i
    return out


def min_cut(to_content: list[float], to_boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the content side of the minimum cut.

    ``to_content[i]`` is paid if node i is called content, ``to_boiler[i]`` if it isn't. A node
    whose costs differ by more than all its edges could add takes the cheaper label in every
    minimum cut; such nodes are settled first and the flow runs over the rest.
    """
    n = len(to_content)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    cc, cb = list(to_content), list(to_boiler)
    label: list[bool | None] = [None] * n
    room = [sum(w for _, w in x) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(cc[i] - cb[i]) <= room[i]:
            continue
        label[i] = cc[i] < cb[i]
        for j, w in near[i]:
            if label[j] is None:
                if label[i]:
                    cb[j] += w
                else:
                    cc[j] += w
                room[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        flow = MaxFlow(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i in rest:
            k = number[i]
            flow.edge(s, k, cb[i], 0.0)
            flow.edge(k, t, cc[i], 0.0)
            for j, w in near[i]:
                if label[j] is None and i < j:
                    flow.edge(k, number[j], w, w)
        side = flow.source_side(s, t)
        for i in rest:
            label[i] = side[number[i]]
    return [bool(x) for x in label]


class MaxFlow:
    """Dinic's algorithm."""

    EPS = 1e-9

    def __init__(self, n: int):
        self.adj: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, a: int, b: int, forth: float, back: float) -> None:
        self.adj[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(forth)
        self.adj[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.adj)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in self.adj[a]:
                b = self.to[e]
                if level[b] < 0 and self.cap[e] > self.EPS:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while True:
            level = self._levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            at = [0] * len(self.adj)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    push = min(self.cap[e] for e in path)
                    for k, e in enumerate(path):
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    k = next(k for k, e in enumerate(path) if self.cap[e] <= self.EPS)
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[a] < len(self.adj[a]):
                    e = self.adj[a][at[a]]
                    if self.cap[e] > self.EPS and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.adj[a]):
                    path.append(e)
                    a = self.to[e]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """The blocks called content, joined by line ends. Null, empty and blank pages give ''."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    has_main = any(b.at.main for b in blocks)
    content, boiler = zip(*(costs(b, has_main) for b in blocks), strict=True)
    keep = min_cut(list(content), list(boiler), edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) for every row of ``pages``.

    Pages are read whole, one at a time; rows that repeat are extracted one by one; null html
    is an empty page with an empty text. An empty table gives no rows. Columns that are
    neither kept nor the html are ignored.
    """
    names = [*keep, "text", "n_chars"]
    kinds = {f.name: f.dataType for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names
            )

    schema = ", ".join([*(f"`{k}` {kinds[k].simpleString()}" for k in keep), "text string", "n_chars long"])
    return small_batches(pages).select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)
