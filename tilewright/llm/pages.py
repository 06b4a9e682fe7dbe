"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block a cost for being called content and one for being called
boilerplate; these are the capacities from the source and to the sink. What it looks at is bounded, each on its own: the
block's words, links and punctuation, and the region it lies in, that is the innermost element whose tag, role or names say what
it holds. Names that say both things say nothing, and no name outweighs an article or main element.

Blocks that follow each other are joined by smoothness edges, the stronger the nearer they stand in the document tree, and so
is each block with the one before it in the same section; edges from one region to another are weak. The maximum flow's cut
separates content from boilerplate with the least total cost, so a short or linked line among prose stays with it, and a sentence
among links goes with them. Markup that can't be text (scripts, styles, forms, ...) is no block at all.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_steps, texts

#: Elements whose insides are no text of a page.
SILENT = frozenset("script style noscript template iframe object svg canvas head title form button select textarea input option label math audio video".split())
#: Silent elements whose insides are read as characters up to their end tag.
RAW = frozenset("script style textarea title noscript iframe template".split())
FORMATTING = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that don't end a block: formatting, and what stands in a line of text without being text.
INLINE = FORMATTING | frozenset("area audio button canvas embed iframe img input label map math noscript object option param picture script select source style svg template textarea track video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of these names ends an open one of the names given.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body div footer header main nav section table td th ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What elements say of their insides: above 0 content, below 0 boilerplate. A header inside an article holds its title.
TAGS = {"article": 5.0, "main": 4.0, "nav": -5.0, "footer": -5.0, "aside": -5.0, "menu": -5.0, "dialog": -5.0, "header": -4.0}
ROLES = {"article": 5.0, "main": 4.0, "navigation": -5.0, "contentinfo": -5.0, "complementary": -5.0, "search": -5.0, "dialog": -5.0, "alert": -5.0, "banner": -4.0}
HEADER_INSIDE = 0.0
#: Words of class names and ids.
BOILER = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe signup login comment comments disqus reply replies respond pagination pager copyright disclaimer skip toolbar widget".split())
DOUBTFUL = frozenset("social share sharing related recommended tags legal respond".split())
CONTENT = frozenset("article post entry content body story main text".split())
BOILER_NAME, DOUBTFUL_NAME, CONTENT_NAME, HIDDEN = -5.0, -2.0, 2.0, -5.0
#: Of what an article or main element's own names may take away from it.
OWN_NAMES = -1.5
REMARKS = frozenset("comment comments reply replies disqus".split())
#: An element that says as much is a region; regions around it count with this share.
DECISIVE, AROUND, BOUND = 1.5, 0.25, 6.0
#: Blocks outside the articles of a page that has any.
OUTSIDE = -3.0

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
TAG = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    element: int  # number of the innermost element that isn't formatting
    scope: int  # number of the section around it
    region: int
    evidence: float  # of the region and those around it
    heading: bool
    inside: bool  # an article or main element is around it


class _Open(NamedTuple):
    """An open element; all but the first two hold for what is inside it."""

    name: str
    element: int
    scope: int
    region: int
    says: float  # the region's own evidence
    around: float  # that of the regions around it
    firm: bool  # the region is boilerplate by a tag, a role or as remarks, which no article inside changes
    silent: bool
    linked: bool
    heading: bool
    inside: bool


class Page(NamedTuple):
    blocks: list[Block]
    parent: list[int]  # of elements by number


def read(page: str) -> Page:
    """Text blocks in page order; white space inside is one space, character references are decoded."""
    out: list[Block] = []
    stack = [_Open("", 0, 0, 0, 0.0, 0.0, False, False, False, False, False)]
    parent, numbers = [0], 0
    places: dict[str, list[int]] = {}  # where elements of a name stand in the stack
    blocks_at = [0]  # where those that aren't formatting do
    parts: list[str] = []
    linked = 0
    silent = ""  # raw element that is open

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            top = stack[-1]
            out.append(Block(text, min(linked, len(text)), top.element, top.scope, top.region, max(-BOUND, min(BOUND, top.says)) + AROUND * top.around, top.heading, top.inside))
        linked = 0

    def characters(data: str) -> None:
        nonlocal linked
        if data and not stack[-1].silent:
            parts.append(data)
            if stack[-1].linked:
                linked += len(data.strip())

    def pop() -> None:
        name = stack.pop().name
        places[name].pop()
        if name not in FORMATTING:
            blocks_at.pop()

    at = 0
    for m in TOKEN.finditer(page):
        token = m.group()
        if m.start() < at:
            continue
        if silent:
            if not (token.startswith("</") and (t := TAG.match(token)) and t.group(1).lower() == silent):
                continue
        else:
            characters(page[at : m.start()])
        at = m.end()
        if token.startswith("<!") or token.startswith("<?"):
            continue
        name = TAG.match(token).group(1).lower()
        open_at = places.get(name)
        if token[1] == "/":
            silent = ""
            if name not in INLINE and not stack[-1].silent:
                flush()
            if open_at and (name not in FORMATTING or open_at[-1] > blocks_at[-1]):  # else a stray end tag
                for _ in range(len(stack) - open_at[-1]):
                    pop()
            continue
        if name not in INLINE and not stack[-1].silent:
            flush()
            while stack[-1].name in FORMATTING and name in BLOCK_ENDS_P:
                pop()
            closes = CLOSES.get(name, set()) | ({"p"} if name in BLOCK_ENDS_P else set())
            if stack[-1].name in closes:
                pop()
        if name in VOID or token.endswith("/>"):
            continue
        top = stack[-1]
        if name not in FORMATTING:
            numbers += 1
            parent.append(top.element)
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(token)}
        says, firm = _evidence(name, attributes, top.inside)
        region, around = top.region, top.around
        article = TAGS.get(name, 0.0) > 0 or ROLES.get(attributes.get("role", "").lower(), 0.0) > 0
        new = abs(says) >= DECISIVE and (says < 0 <= top.says or says > 0 and (top.says >= 0 or article and not top.firm))
        if new and name not in FORMATTING:
            region, around = numbers, max(-BOUND, min(BOUND, top.says + top.around))
        else:
            says, firm = top.says, top.firm or (firm and top.says < 0)
        inside = says > 0 and (top.inside or article) if new else top.inside
        places.setdefault(name, []).append(len(stack))
        if name not in FORMATTING:
            blocks_at.append(len(stack))
        stack.append(_Open(name, top.element if name in FORMATTING else numbers, numbers if name in SCOPES else top.scope, region, says, around, firm, top.silent or name in SILENT, top.linked or name == "a", top.heading or name in HEADINGS, inside))
        if name in RAW:
            silent = name
    if not silent:
        tail = page[at:]
        end = tail.rfind("<")  # a tag that the page ends in
        characters(tail[:end] if end >= 0 and re.match(r"</?[A-Za-z]|<!", tail[end:]) else tail)
    flush()
    return Page(out, parent)


def blocks(page: str) -> list[Block]:
    return read(page).blocks


def _evidence(name: str, attributes: dict[str, str], inside: bool) -> tuple[float, bool]:
    """What an element says of its insides, and whether it says boilerplate by more than a mere name."""
    role = attributes.get("role", "").lower()
    own = HEADER_INSIDE if name == "header" and inside else TAGS.get(name, 0.0)
    own = ROLES[role] if role in ROLES and not own else own
    names = 0.0
    words: set[str] = set()
    if name not in ("body", "html"):
        words = {w.lower() for k in ("class", "id") for w in NAME_WORD.findall(attributes.get(k, ""))}
        if words & CONTENT:
            names = 0.0 if words & (BOILER | DOUBTFUL) else CONTENT_NAME
        elif words & BOILER:
            names = BOILER_NAME
        elif words & DOUBTFUL:
            names = DOUBTFUL_NAME
    remarks = bool(words & REMARKS) and not words & CONTENT
    if own > 0 and not remarks:
        names = max(names, OWN_NAMES)
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", ""):
        return HIDDEN, True
    return max(-BOUND, min(BOUND, own + names)), own <= -DECISIVE or remarks


def costs(block: Block, any_inside: bool) -> tuple[float, float]:
    """(cost of calling it content, cost of calling it boilerplate): the two losses of a logistic score."""
    words = block.text.count(" ") + 1
    prose = 0.7 * math.log(words) - 0.8 - 2.5 * block.linked / len(block.text) + block.heading + 0.7 * (block.text[-1] in ".!?…") - 3.0 * bool(RIGHTS.match(block.text))
    z = max(-4.0, min(2.5, prose)) + block.evidence + (OUTSIDE if any_inside and not block.inside else 0.0)
    return math.log1p(math.exp(-z)), math.log1p(math.exp(z))


#: Weights of edges between neighbours that stand in one element, and of a section's blocks; what is left of them between regions;
#: steps in the document tree beyond which neighbours get no nearer to nothing.
ADJACENT, SIBLING, ACROSS, FAR = 2.0, 0.5, 0.05, 8


def _apart(a: int, b: int, parent: list[int]) -> int:
    """Steps between two elements of the tree, FAR at most. A parent's number is less than its children's."""
    steps = 0
    while a != b and steps < FAR:
        if a > b:
            a = parent[a]
        else:
            b = parent[b]
        steps += 1
    return steps


def edges(page: Page) -> list[tuple[int, int, float]]:
    found, out = page.blocks, []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            a = found[k - 1]
            out.append((k - 1, k, ADJACENT / max(1, _apart(a.element, b.element, page.parent)) * (1.0 if a.region == b.region else ACROSS)))
        if b.scope in last:
            out.append((last[b.scope], k, SIBLING * (1.0 if found[last[b.scope]].region == b.region else ACROSS)))
        last[b.scope] = k
    return out


def cut(n: int, to_content: list[float], to_boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay on the source's (content) side of a minimum cut, by Dinic's algorithm."""
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(there)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):  # what both sides cost is paid anyhow
        d = to_boiler[i] - to_content[i]
        if d > 0:
            link(source, i, d, 0.0)
        elif d < 0:
            link(i, sink, -d, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        here = source
        while True:
            if here == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                here = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[here] < len(head[here]):
                e = head[here][at[here]]
                if cap[e] > tiny and level[to[e]] == level[here] + 1:
                    break
                at[here] += 1
            if at[here] < len(head[here]):
                path.append(head[here][at[here]])
                here = to[path[-1]]
            elif path:
                level[here] = -1
                here = to[path.pop() ^ 1]
                at[here] += 1
            else:
                break


def labels(page: Page, smooth: bool = True) -> list[bool]:
    """Which blocks are content; without smoothing by each one's own costs alone."""
    inside = any(b.inside for b in page.blocks)
    pairs = [costs(b, inside) for b in page.blocks]
    return cut(len(pairs), [c for c, _ in pairs], [c for _, c in pairs], edges(page) if smooth else [])


def main_text(page: str, smooth: bool = True) -> str:
    found = read(page)
    return " ".join(b.text for b, k in zip(found.blocks, labels(found, smooth)) if k) if found.blocks else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points). Null or empty pages, and pages without content, have an empty text.

    Repeated rows repeat; null ids and urls stay. No shuffle.
    """

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            got = [main_text(t) for t in texts(part, "html")]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], ["id", "url", "text", "n_chars"])

        return run

    source = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    out = map_steps(source, "html", make, f"id {source.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col})


