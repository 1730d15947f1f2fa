"""HTML extraction by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path. Each path's text length and punctuation per node
are aggregated, smoothed over neighbouring paths in page order, and fused; paths above the threshold are content. The
smallest subtree that holds the content text is the article, and inside it headings and short paragraphs of lower ratio are kept
too. Where an article or main element holds most of the content text, it is the article, and content outside it is kept as well.
Paths through elements that say they are something else (navigation, forms, adverts, comments) or that are mostly links never count;
a form, or a class or id, says so only if the element holds neither an article nor the bulk of the page's text.

Defined results: null or empty html, and a page without any text, give an empty text; malformed markup is read as far as it goes
(unclosed elements end with their parent); a line break inside a block is white space; elements deeper than ``DEEPEST`` are part of the one around them; rows that repeat give equal rows; an empty table gives an empty table;
other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrygraph.llm.common import column, tune, unused

#: Elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NOT_CONTENT = frozenset("head title nav header footer aside form button menu dialog label input legend fieldset option".split())
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"body", "html", "head", "title", "button", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of class and id attributes that name something other than the article.
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus
    footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related
    replies reply respond response responses search share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored subscribe subscription
    tags toolbar topbar widget widgets alert discussion reactions rail legal disclaimer outbrain taboola paywall""".split()
)
ARTICLE = frozenset("article main".split())
#: Elements that can hold a whole article.
BOXES = frozenset("article main div body html center".split())
LISTS = frozenset("ul ol dl table".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_PUNCT = re.compile(r"[.,;:!?。、，！？；：]")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
MOST_LINKS, SHARE, ALPHA = 0.6, 0.75, 0.35
#: Elements in one another beyond this depth are read as part of the one around them, but for such as are no content.
DEEPEST = 2000


@dataclass
class Node:
    """An element on the way from the root, shared by the text nodes below it."""

    name: str
    key: str
    parent: Node | None
    excluded: bool
    link: bool
    depth: int = 0
    #: says by its class or as a form that it is not the article
    doubtful: bool = False
    #: is an article or main element, and no comment or the like
    article: bool = False


@dataclass
class Text:
    at: Node
    block: int
    text: str


def _excluded(name: str, attrs: str) -> tuple[bool, bool, str]:
    """Whether an element is not the article, whether it only seems so (by a word, or as a form), and its class for the path."""
    if not attrs.strip():
        return name in NOT_CONTENT and name != "form", name == "form", ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    cls = found.get("class", "")
    named = {w.lower() for w in _SPLIT.split(f"{cls} {found.get('id', '')}") if w}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    bad = name in NOT_CONTENT and name != "form" or hidden or role in ROLES and role != "form"
    return bad, name == "form" or role == "form" or name not in ("body", "html") and bool(named & WORDS), cls


def _settle(nodes: list[Node], texts: list[Text]) -> None:
    """Exclude what lies below doubtful elements that hold no article and not the bulk of the text that is no link."""
    doubtful = [n for n in nodes if n.doubtful and n.name not in ARTICLE]
    if not doubtful:
        return
    total = [0, 0]
    held: dict[int, list[int]] = {id(n): [0, 0] for n in doubtful}
    holds: set[int] = set()
    for t in texts:
        if t.at.excluded or t.at.link or t.text.isspace():
            continue
        above: list[Node] = []
        n: Node | None = t.at
        inside = False
        while n is not None:
            if id(n) in held:
                above.append(n)
                if inside:
                    holds.add(id(n))
            inside |= n.article
            n = n.parent
        for i in (0, 1) if inside else (0,):
            total[i] += len(t.text)
            for x in above:
                held[id(x)][i] += len(t.text)
    of = int(total[1] > 0)
    for n in doubtful:
        n.excluded |= id(n) not in holds and 2 * held[id(n)][of] <= total[of]
    for n in nodes:  # parents come first
        n.excluded |= n.parent is not None and n.parent.excluded


def parse(html: str) -> list[Text]:
    """Text nodes in page order, each with the element it is in and the number of its block."""
    root = Node("", "", None, False, False)
    stack, out, block, pos = [root], [], 0, 0
    nodes: list[Node] = []

    def say(raw: str) -> None:
        if raw and not raw.isspace():
            out.append(Text(stack[-1], block, unescape(raw)))
        elif raw:
            out.append(Text(stack[-1], block, " "))

    def pop_to(n: int) -> None:
        del stack[n:]

    size = len(html)
    while pos < size:
        m = _TAG.search(html, pos)
        if m is None:
            say(html[pos:])
            break
        if m.start() > pos:
            say(html[pos : m.start()])
        pos = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                out.append(Text(stack[-1], block, m[1]))
            continue
        name = name.lower()
        if name in BLOCK:
            block += 1
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
            continue
        if name == "br":
            say(" ")
        if name in VOID:
            continue
        if name in RAW:
            if not m[4].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
                pos = end.end() if end else size
            continue
        shut = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in shut:
                pop_to(i)
                break
            if stack[i].name in BLOCK and not (name in CLOSES and stack[i].name not in ("ul", "ol", "dl", "table")):
                break
        bad, doubtful, cls = _excluded(name, m[4])
        up = stack[-1]
        out_of_it = up.excluded or bad
        if up.depth >= DEEPEST and not bad:
            continue
        key = up.key if out_of_it else f"{up.key}/{name}{'.' + cls if cls else ''}"
        stack.append(Node(name, key, up, out_of_it, up.link or name == "a", up.depth + 1, doubtful, name in ARTICLE and not doubtful))
        nodes.append(stack[-1])
    _settle(nodes, out)
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") if len(x) else x


def path_scores(solid: list[Text]) -> dict[str, float]:
    """The fused ratio of each path, in the order of their first nodes; 0 for paths that are mostly links.

    Text length and punctuation per node, each on a logarithmic scale and smoothed over neighbouring paths, are multiplied, and weighed
    by the square root of the path's share of the text.
    """
    paths: dict[str, list[int]] = {}
    for t in solid:
        p = paths.setdefault(t.at.key, [0, 0, 0, 0])
        p[0] += 1
        p[1] += len(t.text)
        p[2] += len(_PUNCT.findall(t.text))
        p[3] += len(t.text) if t.at.link else 0
    size = np.array(list(paths.values()), float)
    length, punct = np.log1p(size[:, 1] / size[:, 0]), np.log1p(size[:, 2] / size[:, 0])
    fused = _smooth(length) * (0.5 + _smooth(punct)) * np.sqrt(size[:, 1] / size[:, 1].sum())
    fused[size[:, 3] > MOST_LINKS * size[:, 1]] = 0
    return dict(zip(paths, fused.tolist(), strict=True))


def extract(html: str | None, alpha: float = ALPHA) -> str:
    """The main text of a page; ``alpha`` is the share of the best path's score from which a path is content."""
    nodes = parse(html or "")
    usable = [t for t in nodes if not t.at.excluded]
    solid = [t for t in usable if not t.text.isspace()]
    if not solid:
        return ""
    scores = path_scores(solid)
    content = {k for k, v in scores.items() if v > 0 and v >= alpha * max(scores.values())}
    if not content:
        return ""
    tops = _article(solid, content)
    linked = _mostly_links(solid, content)
    blocks: dict[int, list[str]] = {}
    for t in usable:
        if (t.at.key in content or _within(t.at, tops)) and id(_block_of(t.at)) not in linked:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(x for x in lines if x)


def _article(solid: list[Text], content: set[str]) -> set[int]:
    """The article or main elements that hold most of the content text, else the deepest element that holds all of it."""
    weight: dict[int, int] = {}
    known: dict[int, Node] = {}
    total = inside = 0
    nearest: set[int] = set()
    for t in solid:
        if t.at.key not in content:
            continue
        total += len(t.text)
        n: Node | None = t.at
        named = None
        while n is not None:
            weight[id(n)] = weight.get(id(n), 0) + len(t.text)
            known[id(n)] = n
            named = named or (n if n.name in ARTICLE else None)
            n = n.parent
        if named:
            inside += len(t.text)
            nearest.add(id(named))
    most = [n for n in known.values() if weight[id(n)] >= SHARE * total and n.name in ARTICLE]
    if most:
        return {id(max(most, key=lambda n: n.depth))}
    if inside >= SHARE * total:
        return nearest
    top = max((n for n in known.values() if weight[id(n)] == total), key=lambda n: n.depth)
    # Text blocks, lists, tables and sections are no container: there are headings and paragraphs beside them.
    while top.parent is not None and top.name not in BOXES:
        top = top.parent
    return {id(top)}


def _within(n: Node | None, tops: set[int]) -> bool:
    while n is not None:
        if id(n) in tops:
            return True
        n = n.parent
    return False


def _block_of(n: Node) -> Node:
    while n.parent is not None and n.name not in BLOCK:
        n = n.parent
    return n


def _mostly_links(solid: list[Text], content: set[str]) -> set[int]:
    """List items and other small boxes that are nothing but links, if they are not the article's.

    The article's are those in an article or main element, and those that stand beside content after its start; of a list
    with other items, a few words as a link are not.
    """
    count: dict[int, list[int]] = {}
    boxes: dict[int, Node] = {}
    words: dict[int, int] = {}
    beside: dict[int, int] = {}
    first: dict[int, int] = {}
    for i, t in enumerate(solid):
        b = _block_of(t.at)
        boxes[id(b)] = b
        first.setdefault(id(b), i)
        c = count.setdefault(id(b), [0, 0])
        c[0] += len(t.text)
        c[1] += len(t.text) if t.at.link else 0
        words[id(b)] = words.get(id(b), 0) + len(t.text.split())
        if t.at.key in content and b.parent is not None:
            beside.setdefault(id(b.parent), i)
    linked = [k for k, (n, links) in count.items() if links == n and boxes[k].name in ("li", "div", "ul", "ol", "td", "dd")]
    mixed = {id(boxes[k].parent) for k, (n, links) in count.items() if links < n and boxes[k].name == "li"}

    def own(k: int) -> bool:
        n: Node | None = boxes[k]
        if n.name == "li" and id(n.parent) in mixed and words[k] < 4:
            return False
        outer = n
        while n is not None:
            if n.name in ARTICLE:
                return True
            if n.name in LISTS:
                outer = n
            n = n.parent
        return beside.get(id(outer.parent), len(solid)) < first[k]

    return {k for k in linked if not own(k)}


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with text and n_chars."""
    tune(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    source = unused(pages, "__html")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extract(h) for h in column(b, source).to_pylist()]
            yield pa.record_batch([*(column(b, c) for c in kept), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*kept, "text", "n_chars"])

    schema = "".join(f"`{c}` {types[c]}, " for c in kept) + "text string, n_chars long"
    return pages.select(*kept, pages[html].cast("string").alias(source)).mapInArrow(rows, schema)
