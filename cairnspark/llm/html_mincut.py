"""Main text of web pages by a minimum cut.

A page is cut into blocks of text. A classifier gives each block a probability
of being content from its words, links, punctuation and the elements and names
around it; the costs of both labels are the capacities to the two terminals.
Neighbouring blocks, and blocks under the same parent, are joined by smoothness
edges that weigh more the closer they are in the document tree. The minimum
cut, found by maximum flow, labels all blocks at once.

Text that is no article by its element (scripts, styles, menus, forms, ...) is
left out or tied to the boilerplate terminal.

What elements and names tell holds for all that they enclose, but not for
html, body and the elements around the article, which are layout.

Defined results: a null or empty page, and one without content, has the empty
text; a tag, comment or script that never ends takes the rest of the page;
markup need not be well formed; pages are judged one by one, so repeated
or null ids and other columns make no difference; very long pages are read in
one pass; an empty table gives no row.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Elements without visible text, void elements, elements that start a block, and elements that never hold an article.
UNSEEN = frozenset("script style noscript template textarea title iframe object svg math canvas audio video datalist".split())
SPACED = frozenset("iframe object svg video audio canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form button select option menu dialog label input search head fieldset".split())
CONTENT = frozenset("article main".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
#: Parts of class, id or role names that tell what an element is for. Firm ones always do; loose ones alone or beside the name of a container, as in ``share-buttons``, but hardly in ``social-issues``.
FIRM = re.compile(r"ads?|advert\w*|sponsor\w*|banner\w*|cookie\w*|consent|popup|modal|menu\w*|nav\w*|breadcrumb\w*|sidebar\w*|widget\w*|footer\w*|masthead|comment\w*|disqus\w*|newsletter\w*|subscri\w*|signup|login|pag(?:er|ination)|copyright|complementary|contentinfo|skip|toolbar", re.I)
LOOSE = re.compile(r"header|share\w*|sharing|social\w*|tags?|form\w*|notice\w*|alert|promo\w*|overlay|side|foot|respon[ds]\w*|repl(?:y|ies)|related\w*|recommend\w*|search\w*|legal|disclaimer", re.I)
HOLDER = re.compile(r"area|bar|block|box|buttons?|cloud|column|container|content|field|group|icons?|inner|items?|left|links?|list|media|more|note|outer|panel|posts?|articles?|stories|products?|right|rail|row|section|site|page|top|bottom|text|topics?|wrap(?:per)?|\d*", re.I)
#: Fixed value: headings above what readers wrote.
READERS = re.compile(r"(?:\d+|no|all|reader|readers'|user|leave a|add a|post a|write a|join the)?\s*(?:comments?|responses?|repl(?:y|ies)|discussion|conversation)(?:\s*[(:].*|\s+(?:to|on|so far|from readers)\b.*)?", re.I)
GOOD = re.compile(r"article\w*|content\w*|post|story|entry|main|body|text", re.I)
#: Names of states and layouts, which tell of the page and not of the element.
STATES = re.compile(r"(?:no|not|has|with|without|is|js)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|active|visible|on|off|layout)", re.I)

OPENING = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ENDS = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*>?", re.I) for name in UNSEEN}
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
STOPS = re.compile(r"[.!?…。](?:\s|$)")

#: Weights of the classifier's features, and of the two kinds of smoothness edges.
W_BIAS, W_WORDS, W_LINKS, W_STOPS, W_INSIDE, W_OUTSIDE, W_BAD, W_GOOD, W_LOOSE, W_HEADING, W_LIST, W_MOST, W_REST = -1.2, 0.7, -5.0, 0.8, 5.0, -4.0, -9.0, 1.2, -2.0, 0.8, -0.8, 3.0, -1.0
SMOOTH_NEXT, SMOOTH_SIBLING = 0.5, 0.6
TIED = 1e6


class Block:
    __slots__ = ("parts", "links", "element", "tag", "text", "never", "bad", "good", "loose", "inside")

    def __init__(self, element: int, tag: str):
        self.parts, self.links, self.element, self.tag = [], 0, element, tag


class Tree:
    """The elements of a page: parent, and of the elements that start a block the nearest one, its parent and its depth."""

    def __init__(self):
        self.parent, self.never, self.bad, self.good, self.loose, self.content, self.header = [0], [False], [False], [False], [False], [False], [False]
        self.box, self.box_parent, self.depth = [0], [0], [0]

    def add(self, parent: int, is_block: bool) -> int:
        k = len(self.parent)
        self.parent.append(parent)
        for flags in (self.never, self.bad, self.good, self.loose, self.content, self.header):
            flags.append(False)
        box = self.box[parent]
        self.box.append(k if is_block else box)
        self.box_parent.append(box)
        self.depth.append(self.depth[parent] + is_block)
        return k

    def distance(self, a: int, b: int) -> int:
        """Steps between the boxes of two elements."""
        a, b, steps = self.box[a], self.box[b], 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, steps = self.box_parent[a], steps + 1
        return steps


def tag_at(page: str, at: int) -> tuple[str, str, int] | None:
    """Name, attributes and end of the tag at a place; None if no tag starts there, an empty name if it never ends."""
    m = OPENING.match(page, at)
    if not m:
        return None
    pos = m.end()
    while e := TAG_END.search(page, pos):
        if e[0] == ">":
            return m[1].lower(), page[m.end() : e.start()], e.end()
        pos = e.end()
        if page[max(m.end(), e.start() - 64) : e.start()].rstrip().endswith("="):  # a quote elsewhere opens no value
            pos = page.find(e[0], pos) + 1
            if not pos:
                break
    return "", "", len(page)


def told_by(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element's attributes hide it, and whether its names, taken together, are bad, good or loosely bad ones."""
    hidden = bad = good = loose = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                if STATES.fullmatch(token):
                    continue
                parts = re.split(r"[-_]+", CAMEL.sub(r"\1-\2", token))
                fine, firm = any(map(GOOD.fullmatch, parts)), any(map(FIRM.fullmatch, parts))
                hints = [p for p in parts if LOOSE.fullmatch(p)]
                rest = [p for p in parts if not LOOSE.fullmatch(p)]
                alone = bool(hints) and all(map(HOLDER.fullmatch, rest)) and not (fine and any(h.lower() in ("header", "share", "tag", "tags") for h in hints))
                bad, good, loose = bad or firm or alone, good or (fine and not firm and not alone), loose or bool(hints)
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name == "style":
            hidden = hidden or bool(NO_DISPLAY.search(value))
    return hidden, bad, good, loose and not good


def blocks_of(page: str) -> tuple[list[Block], bool, Tree]:
    """The page's blocks of text in order, and whether it has an element for its content.

    One pass over the page; each step costs what it reads, opens or closes.
    """
    out: list[Block] = []
    tree = Tree()
    # each open element: name, element, name of its box, depth of its box in the stack, links around it
    stack = [("", 0, "", 0, 0)]
    open_at: dict[str, list[int]] = {}
    block, first, heading, at, n = None, 0, 0, 0, len(page)

    def text(raw: str) -> None:
        nonlocal block
        if block is None:
            if not raw or raw.isspace():
                return
            block = Block(stack[-1][1], stack[-1][2])
            out.append(block)
        block.parts.append(raw)
        if stack[-1][4]:
            block.links += len(raw)

    def shut(depth: int) -> None:
        for name, *_ in stack[depth:]:
            open_at[name].pop()
        del stack[depth:]

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if page.startswith("<!--", start):
            found = None
            end = page.find("-->", start + 4) + 3
        elif page.startswith("<![CDATA[", start):
            found = None
            end = page.find("]]>", start + 9) + 3
        elif page.startswith(("<!", "<?"), start):
            found = None
            end = page.find(">", start + 2) + 1
        elif found := tag_at(page, start):
            end = found[2]
        else:  # no markup
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = end if end > start else n
        if not found or not found[0]:
            continue
        lower, attributes, _ = found
        if page[start + 1] != "/" and lower in UNSEEN:
            if lower in SPACED:
                text(" ")
            if not attributes.endswith("/"):
                over = ENDS[lower].search(page, at)
                at = over.end() if over else n
            continue
        if lower in VOID:
            if lower == "hr":
                block = None
            elif lower == "br":
                text(" ")
            continue
        is_block = lower in BLOCKS
        if is_block:
            block = None
        if page[start + 1] == "/":
            depths = open_at.get(lower)
            if depths and (is_block or depths[-1] > stack[-1][3]):
                shut(depths[-1])
            continue
        if lower in CLOSES:
            while stack[-1][3] and stack[stack[-1][3]][0] in CLOSES[lower]:
                shut(stack[-1][3])
        _, parent, box, box_depth, links = stack[-1]
        k = tree.add(parent, is_block)
        if lower in CONTENT:
            tree.content[k] = True
            first = first or k
        elif lower == "h1":
            heading = heading or k
        hidden, bad, good, loose = told_by(attributes) if attributes and not attributes.isspace() and lower not in ("html", "body") else (False, False, False, False)
        tree.never[k], tree.header[k], tree.bad[k], tree.good[k], tree.loose[k] = hidden or lower in NEVER, lower == "header", bad, good, loose
        if not attributes.endswith("/"):
            open_at.setdefault(lower, []).append(len(stack))
            stack.append((lower, k, lower if is_block else box, len(stack) if is_block else box_depth, links + (lower == "a")))
    kept = []
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    judge(tree, kept, first or heading)
    return kept, first > 0, tree


def judge(tree: Tree, blocks: list[Block], core: int) -> None:
    """Gives blocks what the elements around them tell.

    The core, the first element for content or else the first main heading,
    and the elements around it are layout, whose names tell nothing; without a
    core those are that hold more than half of the text. A page without an
    element for content has the smallest one instead that holds three quarters
    of the text outside of links, menus and the like.

    What stands under a heading above readers' words is theirs: the heading's
    parent, or what follows in it if it is layout.
    """
    n = len(tree.parent)
    layout = [False] * n
    if core:
        k = core
        while k:
            layout[k], k = True, tree.parent[k]
    else:
        size = [0] * n
        for b in blocks:
            size[b.element] += len(b.text)
        for k in range(n - 1, 0, -1):
            size[tree.parent[k]] += size[k]
        layout = [2 * s > size[0] for s in size]
    marked: set[int] = set()
    for i, b in enumerate(blocks):
        if b.tag[:1] == "h" and b.tag[1:].isdigit() and READERS.fullmatch(b.text):
            parent = tree.box_parent[tree.box[b.element]]
            if not layout[parent]:
                tree.never[parent] = True
            if not layout[parent] or parent in marked:
                continue
            marked.add(parent)
            for c in blocks[i:]:
                k = tree.box[c.element]
                while k and tree.box_parent[k] != parent:
                    k = tree.box_parent[k]
                if not k:
                    break
                tree.never[k] = True
    never, bad, good, loose, inside = [False] * n, [False] * n, [False] * n, [False] * n, [False] * n
    for k in range(1, n):  # parents come first
        p = tree.parent[k]
        own = not layout[k]
        never[k] = never[p] or (own and (tree.never[k] or (tree.header[k] and not inside[p])))
        bad[k], good[k], inside[k] = bad[p] or (own and tree.bad[k]), good[p] or tree.good[k], inside[p] or tree.content[k]
        loose[k] = loose[p] or (own and tree.loose[k])
    if not any(tree.content):
        size = [0] * n
        for b in blocks:
            if not never[b.element] and not bad[b.element]:
                size[b.element] += max(0, len(b.text) - b.links)
        for k in range(n - 1, 0, -1):
            size[tree.parent[k]] += size[k]
        k = 0
        for j in range(1, n):
            if tree.parent[j] == k and tree.box[j] == j and 4 * size[j] >= 3 * size[0] > 0:
                k = j
        held = [False] * n
        for j in range(1, n):
            held[j] = j == k or held[tree.parent[j]] or k == 0
        inside = held
    for b in blocks:
        b.never, b.bad, b.good, b.loose, b.inside = never[b.element], bad[b.element], good[b.element], loose[b.element], inside[b.element]


def score(b: Block, has_content: bool) -> float:
    """Log odds of being content."""
    words = b.text.count(" ") + 1
    raw = sum(map(len, b.parts))
    s = W_BIAS + W_WORDS * math.log(words) + W_LINKS * b.links / max(1, raw) + W_STOPS * min(3, len(STOPS.findall(b.text))) / 1.5
    if has_content:
        s += W_INSIDE if b.inside else W_OUTSIDE
    else:
        s += W_MOST if b.inside else W_REST
    if b.bad:
        s += W_BAD
    elif b.loose:
        s += W_LOOSE
    if b.good:
        s += W_GOOD
    if b.tag[:1] == "h" and b.tag[1:].isdigit():
        s += W_HEADING
    elif b.tag == "li":
        s += W_LIST
    return s


def edges_of(blocks: list[Block], tree: Tree) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours in the text and neighbours under one parent."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            out.append((k - 1, k, SMOOTH_NEXT / (1 + tree.distance(blocks[k - 1].element, b.element))))
        parent = tree.box_parent[tree.box[b.element]]
        if parent in last:
            out.append((last[parent], k, SMOOTH_SIBLING / 3))
        last[parent] = k
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of the minimum cut, by Dinic's blocking flows.

    Nodes count as cut off from the source unless a residual path reaches them.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a, b, forth, back):
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in range(n):
        through = min(source[k], sink[k])
        if source[k] > through:
            join(s, k, source[k] - through, 0.0)
        if sink[k] > through:
            join(k, t, sink[k] - through, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[first] ^ 1]
                del path[first:]
            while nexts[a] < len(at[a]):
                e = at[a][nexts[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, has_content, tree = blocks_of(page)
    source, sink = [], []
    for b in blocks:
        if b.never:
            source.append(0.0)
            sink.append(TIED)
            continue
        x = max(-30.0, min(30.0, score(b, has_content)))
        source.append(math.log1p(math.exp(x)))  # the cost of calling it boilerplate
        sink.append(math.log1p(math.exp(-x)))
    keep = minimum_cut(source, sink, edges_of(blocks, tree))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, column: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with the main text of each whole page and its number of code points, without the page itself; other columns named text or n_chars give way."""
    common.tune(pages.sparkSession)
    new = [T.StructField(text, T.StringType(), False), T.StructField(n_chars, T.LongType(), False)]
    kept = [f for f in pages.schema.fields if f.name.lower() not in {column.lower(), text.lower(), n_chars.lower()}]

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*(f.name for f in kept), text, n_chars])

    return pages.mapInArrow(common.trimmed(run), T.StructType([*kept, *new]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
