"""Main text of web pages: text blocks labelled by a minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import ship

# Names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("br hr img input meta link area base col embed source track wbr".split())
HIDDEN_TAGS = frozenset("script style template noscript svg iframe object canvas head annotation annotation-xml".split())
RAW_TAGS = frozenset("script style textarea title".split())
# Tags that end an open element of the same kind, as their end tags may be left out.
SELF_CLOSING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]+|<",
    re.DOTALL,
)
# The same without regard to quotes, and what follows the last ">" of a page.
UNQUOTED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>()()()|<[!?/][^>]*>|[^<]+|<", re.DOTALL
)
TAIL = re.compile(r"<!--.*|[^<]+|<()()()()()()", re.DOTALL)
# After so many tags whose quotes are not closed, quotes do not count on the rest of a page.
BROKEN_QUOTES = 16
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BOILERPLATE_TAGS = frozenset(
    "nav footer aside form menu button select dialog header search fieldset".split()
)
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment "
    "comments complementary contentinfo cookie cookies consent copyright disclaimer disqus footer "
    "form gdpr header legal links login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification outbrain pagination pager popup privacy promo promoted promotion "
    "recommended related replies reply respond response responses search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription taboola tags teaser toolbar trending widget".split()
)
# Of these, names that parts of an article have as well; inside one they are weak evidence.
ARTICLE_PARTS = frozenset(
    "banner disclaimer footer form header legal links menu related search skip tags teaser".split()
)
# Elements of text, whose names often come from their titles.
TEXT_TAGS = frozenset(
    "p pre blockquote h1 h2 h3 h4 h5 h6 table caption thead tbody tfoot tr td th figure figcaption "
    "dl dt dd li hgroup".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_NAMES = frozenset("article body content entry main page post story text".split())


@dataclass
class Block:
    """A run of text inside one block element, by its number; ``bias`` is what the tags and names
    of that element and of those around it tell."""

    element: int
    tag: str
    bias: float
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Element:
    """A block element; ``parent`` has a smaller number. ``classes`` are the words of each name."""

    tag: str
    classes: list[list[str]]
    parent: int
    depth: int
    names: set[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = {word for parts in self.classes for word in parts}


def blocks(page: str) -> list[Block]:
    return parsed(page)[0]


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, without those that have no text.

    Elements that nobody closes end with their parent; comments, scripts, styles and other
    hidden elements give no text. Character references are decoded, and white space becomes
    one space inside a block. Time is linear in the page: no search that failed is repeated.
    """
    found: list[Block] = []
    # Open block elements, and all of them in order: number and tag; tag, names and parent.
    stack: list[tuple[int, str]] = [(0, "")]
    elements = [Element("", [], 0, 0)]
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    links, position, end, last = 0, 0, len(page), page.rfind(">")
    pattern, broken = TOKEN, 0
    current: Block | None = None
    while position < end:
        if position > last:
            pattern = TAIL
        token = pattern.match(page, position)
        if token[5] and pattern is TOKEN:
            broken += 1
            if broken == BROKEN_QUOTES:
                pattern = UNQUOTED
        position = token.end()
        name = token[2] or token[5]
        if not name:
            piece = token[0]
            if piece[0] != "<" or piece == "<":
                if current is None:
                    current = Block(stack[-1][0], stack[-1][1], 0.0)
                    found.append(current)
                current.parts.append(piece)
                if links:
                    current.linked += len(piece)
            continue
        name, closing = name.lower(), bool(token[1] or token[4])
        attributes = token[3] or token[6] or ""
        if not closing and (name in RAW_TAGS or name in HIDDEN_TAGS):
            if name == "head":  # holds raw elements of its own; ends by a tag or by the body
                continue
            if attributes.endswith("/") and name not in RAW_TAGS:
                continue
            position = _end_of(page, name, position, endless) or end
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br" and current is not None:
            current.parts.append(" ")
        if name not in BLOCK_TAGS:
            if not closing and name in BOILERPLATE_TAGS and name not in VOID_TAGS:
                position = _end_of(page, name, position, endless) or position
            continue
        current = None
        if closing:
            if opened[name]:
                _close(stack, name, opened)
            continue
        _open(stack, name, opened)
        if name not in VOID_TAGS:
            parent = stack[-1][0]
            elements.append(Element(name, _classes(attributes), parent, elements[parent].depth + 1))
            stack.append((len(elements) - 1, name))
            opened[name] += 1
    for block in found:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    found = [b for b in found if b.text]
    biases = _biases(elements, found)
    for block in found:
        block.bias = biases[block.element]
    return found, elements


def _end_of(page: str, name: str, position: int, endless: set[str]) -> int | None:
    """Where the end tag of an element ends, if there is one. ``endless`` remembers for which
    names there is none, as none follows later either."""
    if name in endless:
        return None
    over = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, position)
    if over is None:
        endless.add(name)
        return None
    return over.end()


def _close(stack: list[tuple[int, str]], name: str, opened: Counter[str]) -> None:
    """Ends the innermost open element ``name``, and all inside it."""
    while True:
        _, closed = stack.pop()
        opened[closed] -= 1
        if closed == name:
            return


def _open(stack: list[tuple[int, str]], name: str, opened: Counter[str]) -> None:
    """Ends what cannot hold the new element: a paragraph, or an open item of its kind."""
    if stack[-1][1] == "p":
        opened[stack.pop()[1]] -= 1
    if stack[-1][1] in SELF_CLOSING.get(name, ()):
        opened[stack.pop()[1]] -= 1


def _classes(attributes: str) -> list[list[str]]:
    """The words of each class, id and role: those of ``entry-header`` are entry and header."""
    if not attributes:
        return []
    values = ("".join(value) for value in NAMED.findall(attributes))
    return [[p.lower() for p in NAME_PARTS.findall(one)] for value in values for one in value.split()]


def _doubtful(element: Element) -> bool:
    """Whether an element is boilerplate by its names, or a form, which may also hold a page."""
    tag = element.tag
    return tag == "form" or (tag != "main" and bool(element.names & BOILERPLATE_NAMES))


def _surely_doubtful(element: Element) -> bool:
    """The same inside an article: there, elements of text are not judged by their names, and
    neither are others by names that parts of articles have, or by names of more than three words,
    which are rather titles."""
    if element.tag == "form":
        return True
    if element.tag in TEXT_TAGS:
        return False
    sure = BOILERPLATE_NAMES - ARTICLE_PARTS
    return any(len(parts) <= 3 and not sure.isdisjoint(parts) for parts in element.classes)


def _summed(elements: list[Element], own: list[int]) -> list[int]:
    """For each element the sum of ``own`` over it and all inside it."""
    sums = list(own)
    for i in range(len(elements) - 1, 0, -1):
        sums[elements[i].parent] += sums[i]
    return sums


def _holders(elements: list[Element], found: list[Block]) -> tuple[set[int], int]:
    """The elements that hold at least half of what is most likely the main text, and which kind
    that is: the text of articles (0), or else of the main element (1), of articles in doubtful
    elements (2), of elements with names of content (3), of the page (4)."""
    kinds: list[set[int]] = [set() for _ in range(4)]
    hard, soft = [False], [False]
    for i, element in enumerate(elements[1:], 1):
        tag, parent = element.tag, element.parent
        hard.append(hard[parent] or tag in BOILERPLATE_TAGS - {"form"})
        soft.append(soft[parent] or _doubtful(element))
        if hard[i]:
            continue
        if tag == "article" and not soft[i]:
            kinds[0].add(i)
        elif tag == "main":
            kinds[1].add(i)
        elif tag == "article":
            kinds[2].add(i)
        elif element.names & CONTENT_NAMES and not soft[i] and tag not in ("html", "body"):
            kinds[3].add(i)
    for kind, core in enumerate((*kinds, {0})):
        if not core:
            continue
        inside = [0 in core]
        for i, element in enumerate(elements[1:], 1):
            inside.append(inside[element.parent] or i in core)
        own = [0] * len(elements)
        for block in found:
            if inside[block.element] and not hard[block.element]:
                own[block.element] += len(block.text)
        sizes = _summed(elements, own)
        if sizes[0]:
            return {i for i, size in enumerate(sizes) if size and 2 * size >= sizes[0]}, kind
    return set(), len(kinds)


def _answers(elements: list[Element], found: list[Block]) -> set[int]:
    """Articles inside an article that has at least as much text of its own: answers to it."""
    if sum(e.tag == "article" for e in elements) < 2:
        return set()
    around = [0] * len(elements)  # the innermost article around an element, itself included
    for i, element in enumerate(elements[1:], 1):
        around[i] = i if element.tag == "article" else around[element.parent]
    own = [0] * len(elements)
    for block in found:
        own[around[block.element]] += len(block.text)
    inner = [0] * len(elements)  # text of articles inside an article
    total = list(own)
    for i in range(len(elements) - 1, 0, -1):
        outer = around[elements[i].parent]
        if elements[i].tag == "article" and outer:
            total[outer] += total[i]
            inner[outer] += total[i]
    nested = ((i, around[e.parent]) for i, e in enumerate(elements) if e.tag == "article")
    return {i for i, outer in nested if outer and own[outer] >= inner[outer]}


def _biases(elements: list[Element], found: list[Block]) -> list[float]:
    """Evidence for content of each element: that of its own tag and names decides if there is
    any. Nothing inside a tag of boilerplate turns into content; inside a form or an element
    with such names only <main> does, and <article> if there is no other one, and neither
    counts for an element that holds the main text. Inside content, names that parts of an article
    have as well only lower the evidence, so that the cut decides."""
    holders, kind = _holders(elements, found)
    answers = _answers(elements, found)
    biases, hard = [0.0], [False]
    for i, element in enumerate(elements[1:], 1):
        tag, parent = element.tag, element.parent
        outer, closed = biases[parent], hard[parent]
        doubtful = _doubtful(element) and i not in holders
        if tag in BOILERPLATE_TAGS - {"form"} and not (tag == "header" and outer > 0):
            own, closed = -6.0, True
        elif closed:
            own = outer
        elif i in answers and i not in holders:
            own = -6.0
        elif doubtful and (outer <= 0 or _surely_doubtful(element)):
            own = -6.0
        elif doubtful:
            own = outer if tag in TEXT_TAGS else max(0.5, outer - 2.5)
        elif tag in CONTENT_TAGS and outer >= 0:
            own = 4.0
        elif tag == "main" or (tag == "article" and (kind == 2 or i in holders)):
            own = 1.0
        elif element.names & CONTENT_NAMES and outer >= 0:
            own = max(outer, 2.0)
        else:
            own = outer
        biases.append(own)
        hard.append(closed)
    return biases


def content_cost(block: Block) -> float:
    """Log-odds that a block is content: a fixed linear classifier of its place, its tag,
    its share of linked text, its length and its punctuation."""
    length, text = len(block.text), block.text
    share = min(1.0, block.linked / max(1, sum(map(len, block.parts))))
    score = block.bias - 0.5 - 3.0 * share
    if block.tag in ("p", "pre", "blockquote"):
        score += 1.0
    elif block.tag in ("h1", "h2", "h3"):
        score += 0.5
    score += 0.4 * min(4.0, math.log1p(length / 20))
    if text[-1] in ".!?:;\"')…。":
        score += 0.5
    return score


ADJACENT, SIBLINGS = 0.4, 0.4


def smoothness(found: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours on the page, more the nearer they are in the tree, and
    the next block with the same parent."""
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            apart = _apart(elements, found[i - 1].element, block.element)
            edges.append((i - 1, i, ADJACENT / (1 + apart / 2)))
        parent = elements[block.element].parent if block.element else -1
        if parent in last:
            edges.append((last[parent], i, SIBLINGS))
        last[parent] = i
    return edges


def _apart(elements: list[Element], a: int, b: int) -> int:
    """Steps between two elements of the tree. Blocks come in the order of the tree, so over a page
    these are no more than two for each element."""
    steps = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut.

    A node with score s has a terminal edge of capacity |s|, from the source if s > 0 and to
    the sink if not, so that cutting it costs |s|; an edge between nodes costs its weight if
    its ends differ. Nodes whose own score outweighs all their edges are settled first and
    passed on to their neighbours' scores, which changes no minimum; the flow is computed on
    what remains. Undecided nodes go to the sink side.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, weight in edges:
        near[a][b] = near[a].get(b, 0.0) + weight
        near[b][a] = near[b].get(a, 0.0) + weight
    scores, side = list(scores), [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if side[i] is None and abs(scores[i]) > sum(near[i].values()):
            side[i] = scores[i] > 0
            for j, weight in near[i].items():
                scores[j] += weight if side[i] else -weight
                del near[j][i]
                if side[j] is None:
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        reached = _source_side(rest, scores, near)
        for i in rest:
            side[i] = i in reached
    return side


def _source_side(rest: list[int], scores: list[float], near: list[dict[int, float]]) -> set[int]:
    """Maximum flow by blocking flows in level graphs; what the source still reaches after it.

    Arcs come in pairs, so that ``arc ^ 1`` is the one back. All shortest paths of a length are
    filled in one phase, whose number follows how far flow has to go and not the blocks.
    """
    tiny = 1e-12
    number = {i: k for k, i in enumerate(rest, 2)}
    source, sink = 0, 1
    heads: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def connect(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(heads))
        arcs[b].append(len(heads) + 1)
        heads.extend((b, a))
        room.extend((forth, back))

    for i, k in number.items():
        if scores[i] > 0:
            connect(source, k, scores[i], 0.0)
        elif scores[i] < 0:
            connect(k, sink, -scores[i], 0.0)
        for j, weight in near[i].items():
            if number[j] > k:
                connect(k, number[j], weight, weight)
    while True:
        level = [-1] * len(arcs)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for arc in arcs[a]:
                b = heads[arc]
                if room[arc] > tiny and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            return {i for i, k in number.items() if level[k] >= 0}
        following = [0] * len(arcs)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[arc] for arc in path)
                full = len(path)
                for depth, arc in enumerate(path):
                    room[arc] -= flow
                    room[arc ^ 1] += flow
                    if full == len(path) and room[arc] <= tiny:
                        full = depth
                a = heads[path[full] ^ 1]
                del path[full:]
                continue
            mine = arcs[a]
            while following[a] < len(mine):
                arc = mine[following[a]]
                if room[arc] > tiny and level[heads[arc]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if not path:
                    break
                a = heads[path.pop() ^ 1]
                following[a] += 1
                continue
            path.append(arc)
            a = heads[arc]


def main_text(page: str | None) -> str:
    """The blocks of a page that the minimum cut labels as content, one per line."""
    found, elements = parsed(page or "")
    kept = minimum_cut([content_cost(b) for b in found], smoothness(found, elements))
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def with_main_text(
    pages: DataFrame, markup: str = "html", name: str = "main_text"
) -> DataFrame:
    """``pages`` with the main text of each whole page as a string ``name``.

    Null, empty and text-free pages give ''; repeated rows each give theirs, an empty table an
    empty one; a column ``name`` is replaced. One scan without a shuffle; a page is the unit of
    work, and its time is linear in its length.
    """
    require_columns(pages, markup)
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([main_text(t) for t in texts], dtype="object")

    return pages.withColumn(name, extract(col(markup)))
