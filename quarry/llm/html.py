"""Main-text extraction by a minimum cut.

A page becomes blocks of text in order. A linear classifier says how costly it is to call each block content
or boilerplate; those costs are the capacities from the source and to the sink. Edges between neighbouring
blocks and between blocks that share a close ancestor make it costly to part them. The maximum flow's cut is
the labelling of least total cost.

The classifier adds what the elements around a block are called to what its shape says (links, length,
heading, sentence). The weights of shapes are fitted to the pages themselves: blocks whose surroundings leave
no doubt are the labelled ones, and what they teach decides about blocks that nothing else tells apart.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_text

#: Elements that end a block. Fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without text of the page. Fixed values.
SILENT = frozenset("script style template noscript iframe object embed applet svg math canvas audio video head title".split())
#: Of these, the ones whose content is not markup. Fixed values.
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open p; list items and cells end their like. Fixed values.
CLOSES_P = BLOCK_TAGS - frozenset("body button caption html legend li option tbody td tfoot th thead tr".split())
CLOSES_LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Costs that an element around a block adds, by tag. Positive: boilerplate.
TAG_COST = {"nav": 9.0, "header": 3.0, "footer": 9.0, "aside": 9.0, "form": 9.0, "button": 9.0, "select": 9.0, "textarea": 9.0, "fieldset": 9.0, "dialog": 9.0, "menu": 9.0, "article": -5.0, "main": -4.0, "figcaption": -0.5, "blockquote": -0.5}
#: The same by words of its class, id, role or label. The words are matched whole, or as a part of a longer name.
NAME_COST = (
    (re.compile(r"(?<![a-z])(?:ad|ads|advert\w*|adv|sponsor\w*|promo\w*|banner|teaser|outbrain|taboola)(?![a-z])"), 9.0),
    (re.compile(r"(?<![a-z])(?:comment\w*|disqus|replies|reply|respond|discussion|reactions?)(?![a-z])"), 12.0),
    (re.compile(r"(?<![a-z])(?:nav\w*|menus?|breadcrumbs?|pagination|pager|toc|skip|tabs?|toolbar)(?![a-z])"), 8.0),
    (re.compile(r"(?<![a-z])(?:footer|foot|header|masthead|sidebar|side|aside|widget\w*|rail|related|recommend\w*|share|sharing|social|tags?|meta|byline)(?![a-z])"), 7.0),
    (re.compile(r"(?<![a-z])(?:cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe|newsletter|signup|login|paywall|copyright|legal|disclaimer)(?![a-z])"), 9.0),
    (re.compile(r"(?<![a-z])(?:article\w*|content|post|entry|story|main|body|text|prose)(?![a-z])"), -2.0),
)
#: A cost from which a place counts as boilerplate whatever stands around it.
CERTAIN = 6.0
#: Shapes: upper ends of the bins of the share of linked text, and of the length. Longer or more is the last bin.
LINKED, LENGTHS = (0.0, 0.25, 0.5, 0.8), (24, 59, 120, 300)
#: Weights of shapes before any page is seen (log-odds of boilerplate): constant, bins of links, bins of length,
#: heading, end of a sentence.
PRIOR = (0.2, 0.0, 0.4, 1.3, 2.3, 3.3, 0.6, 0.0, 0.0, -1.2, -1.2, -1.4, -0.6)
#: Pages that the weights are fitted to, at most about (by hash of their rows); pull towards PRIOR; as many labelled
#: blocks as PRIOR itself counts for; largest weight.
FIT_PAGES, PULL, PRIOR_BLOCKS, MOST_WEIGHT = 2000, 0.05, 500, 3.5
#: Capacity between neighbours in the page, and of blocks with the same parent, each halved a level up.
NEXT_TO, CLOSE, LEVELS = 0.5, 1.0, 3

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag up to its end outside quotes; possessive, so that it never goes back.
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Attributes whose words name an element's purpose. Those of html and body name the layout, not what is in them.
NAMES, WHOLE = frozenset("class id role aria-label".split()), frozenset("html body".split())
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?…:;][\"'»”)]*$")


@dataclass
class Node:
    """An open element: its tag, its place in the tree, and what it and those around it say about its text.

    ``bad`` is the largest cost around, ``good`` the least (negative). Boilerplate within an article stays
    boilerplate, so what is bad enough leaves no room for what is good.
    """

    tag: str
    up: Node | None
    bad: float
    good: float
    silent: bool
    number: int
    depth: int = 0

    @property
    def cost(self) -> float:
        return self.bad if self.bad >= CERTAIN else self.bad + self.good


@dataclass
class Block:
    """Text between two block boundaries."""

    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""


def _named(attrs: str) -> tuple[float, float, bool]:
    """Largest and least cost by the names in an element's attributes, and whether it is hidden."""
    bad, good, hidden = 0.0, 0.0, False
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.strip() == "true"
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif value and key in NAMES:
            for pattern, c in NAME_COST:
                if pattern.search(value.replace("_", "-")):
                    bad, good = max(bad, c), min(good, c)
                    break
    return bad, good, hidden


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order, in time linear in the page.

    Broken markup never fails: stray ends are left out, open elements end with the page, and a tag or comment
    that is not closed ends the page's text. After a quote that is never closed, tags end at their first ``>``.
    """
    root = Node("", None, 0.0, 0.0, False, 0)
    now, count, links = root, 0, 0
    opened: dict[str, list[Node]] = defaultdict(list)  # open elements by tag, innermost last
    outer: list[Node] = []  # open elements that are blocks
    out: list[Block] = []
    block = Block(root)
    quotes = True

    def cut() -> None:
        nonlocal block
        if block.parts:
            block.text = _SPACE.sub(" ", html.unescape("".join(block.parts))).strip()
            if block.text:
                out.append(block)
        block = Block(now)

    def say(text: str) -> None:
        if text and not now.silent:
            if not block.parts:
                block.node = now
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())

    def leave(node: Node) -> None:
        """Go out of ``node`` and all that is open in it."""
        nonlocal now, links
        while True:
            done = now
            opened[done.tag].pop()
            if outer and outer[-1] is done:
                outer.pop()
            links -= done.tag == "a"
            now = done.up
            if done is node:
                return

    def innermost(tags: tuple[str, ...]) -> Node:
        return max((opened[t][-1] for t in tags if opened[t]), key=lambda n: n.depth, default=root)

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        say(page[at:start])
        mark = page[start + 1 : start + 2]
        ends = mark == "/"
        name = _NAME.match(page, start + 1 + ends) if mark else None
        if name is None:
            if mark == "!" and page.startswith("<!--", start):
                close, after = page.find("-->", start + 4), 3
            elif mark == "!" and page.startswith("<![CDATA[", start):
                close, after = page.find("]]>", start + 9), 3
                say(html.escape(page[start + 9 : close if close >= 0 else size]))
            elif mark in ("!", "?", "/"):
                close, after = page.find(">", start), 1
            else:
                say("<")
                at = start + 1
                continue
            at = close + after if close >= 0 else size
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        if rest is None:
            quotes = False
            close = page.find(">", name.end())
            if close < 0:
                break
            attrs, at = page[name.end() : close], close + 1
        else:
            attrs, at = page[name.end() : rest.end() - 1], rest.end()
        tag = name.group().lower()
        if ends:
            if opened[tag]:
                if tag in BLOCK_TAGS:
                    cut()
                leave(opened[tag][-1])
                if tag in BLOCK_TAGS:
                    block.node = now
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in CLOSES_P:
            cut()
            if outer and outer[-1].tag == "p":
                leave(outer[-1])
        elif tag in CLOSES_LIKE:
            cut()
            like = innermost((tag,))
            if like.depth > innermost(CLOSES_LIKE[tag]).depth:
                leave(like)
        elif tag in BLOCK_TAGS:
            cut()
        if tag in VOID:
            continue
        bad, good, hidden = _named(attrs) if attrs.strip() else (0.0, 0.0, False)
        if tag in WHOLE:
            bad, good = 0.0, 0.0
        cost = TAG_COST.get(tag, 0.0)
        count += 1
        if not attrs.endswith("/") or tag not in ("svg", "math", "path"):
            now = Node(tag, now, max(now.bad, bad, cost), min(now.good, good, cost), now.silent or hidden or tag in SILENT, count, now.depth + 1)
            opened[tag].append(now)
            if tag in BLOCK_TAGS:
                outer.append(now)
            links += tag == "a"
            if not block.parts:
                block.node = now
                block.heading = tag[0] == "h" and tag[1:].isdigit() or (block.heading and tag not in BLOCK_TAGS)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?![^\s/>])[^>]*>?", re.I).search(page, at)
                end = close.start() if close else size
                say(page[at:end])
                at = close.end() if close else size
                if tag in BLOCK_TAGS:
                    cut()
                leave(now)
    cut()
    return out


# --- classifier ---------------------------------------------------------------------------------


def shape_of(block: Block) -> tuple[int, int, bool, bool]:
    """Bin of the share of linked text, bin of the length, whether it is a heading, and whether it ends as a sentence."""
    n = len(block.text)
    return bisect_left(LINKED, min(1.0, block.linked / n)), bisect_left(LENGTHS, n), block.heading, _END.search(block.text, max(0, n - 20)) is not None


def row_of(shape: tuple[int, int, bool, bool]) -> np.ndarray:
    """A shape as what each weight is multiplied by. A heading's length says nothing."""
    linked, length, heading, sentence = shape
    row = np.zeros(len(PRIOR))
    row[0], row[1 + linked], row[12] = 1, 1, sentence
    if heading:
        row[11] = 1
    else:
        row[6 + length] = 1
    return row


def seen_label(block: Block) -> int | None:
    """1 if the elements around a block leave no doubt that it is boilerplate, 0 if that it is content."""
    node = block.node
    return 1 if node.bad >= CERTAIN else 0 if node.bad == 0 and node.good <= TAG_COST["main"] else None


def fitted(counts: dict[tuple[tuple[int, int, bool, bool], int], int]) -> tuple[float, ...]:
    """Weights of a logistic regression over counts of (shape, label), classes weighed equally, pulled towards PRIOR."""
    total = Counter()
    for (_, y), n in counts.items():
        total[y] += n
    if len(total) < 2:
        return PRIOR
    keys = sorted(counts)
    x, y = np.array([row_of(k) for k, _ in keys]), np.array([y for _, y in keys], float)
    told = total[0] + total[1]
    share = np.array([0.5 * counts[k] / total[k[1]] for k in keys]) * told / (told + PRIOR_BLOCKS)
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w)), x.T @ (share * (p - y)) + PULL * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(np.clip(w, -MOST_WEIGHT, MOST_WEIGHT).tolist())


def fit(pages: DataFrame) -> tuple[float, ...]:
    """Weights of shapes, from about FIT_PAGES pages at most. Shapes are counted on the executors: a few hundred counts come back."""
    rows = pages.count()
    taken = pages.select("html").where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < F.ceil(F.lit(1e6 * min(1.0, FIT_PAGES / max(1, rows))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for page in b.column(0):
                found.update((shape_of(x), y) for x in blocks_of(page.as_py()) if (y := seen_label(x)) is not None)
        columns = list(zip(*((*shape, y, n) for (shape, y), n in found.items()), strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["linked", "length", "heading", "sentence", "label", "n"])

    counted = map_text(taken, run, "linked int, length int, heading boolean, sentence boolean, label int, n long").groupBy("linked", "length", "heading", "sentence", "label").agg(F.sum("n").alias("n"))
    return fitted({((r.linked, r.length, r.heading, r.sentence), r.label): r.n for r in counted.collect()})


def costs(block: Block, weights: tuple[float, ...] = PRIOR) -> float:
    """Log-odds that a block is boilerplate: what stands around it, and its shape."""
    linked, length, heading, sentence = shape_of(block)
    return block.node.cost + weights[0] + weights[1 + linked] + (weights[11] if heading else weights[6 + length]) + weights[12] * sentence


def minimum_cut(to_sink: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each block whether it stays on the source's side (content).

    ``to_sink[i]`` is the log-odds of boilerplate: if positive, the capacity from i to the sink is that much,
    else from the source to i. ``edges`` are capacities both ways. Maximum flow by shortest augmenting
    paths with levels (Dinic).
    """
    n = len(to_sink)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(to_sink):
        if x > 0:
            edge(i, t, x, 0.0)
        elif x < 0:
            edge(s, i, -x, 0.0)
    for (a, b), c in edges.items():
        edge(a, b, c, c)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        step = [0] * (n + 2)
        while True:  # one augmenting path after another in the level graph
            path: list[int] = []
            a = s
            while a != t:
                edges_of = out[a]
                while step[a] < len(edges_of):
                    e = edges_of[step[a]]
                    if cap[e] > least and level[to[e]] == level[a] + 1:
                        break
                    step[a] += 1
                else:
                    if a == s:
                        break
                    level[a] = -1
                    a = to[path.pop() ^ 1]
                    step[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != t:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


def content_of(blocks: list[Block], weights: tuple[float, ...] = PRIOR) -> list[bool]:
    """Which blocks are the main text."""
    if not blocks:
        return []
    edges: dict[tuple[int, int], float] = {}

    def link(a: int, b: int, c: float) -> None:
        edges[(a, b)] = edges.get((a, b), 0.0) + c

    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            link(i - 1, i, NEXT_TO)
        node, c = b.node.up, CLOSE
        for _ in range(LEVELS):  # the block before under the same ancestor: a chain, not all pairs
            if node is None or not node.tag or node.tag in ("body", "html"):
                break
            if node.number in last and last[node.number] != i:
                link(last[node.number], i, c)
            last[node.number] = i
            node, c = node.up, c / 2
    scores = [costs(b, weights) for b in blocks]
    if max(scores) <= 0 or min(scores) >= 0:  # nothing flows
        return [x < 0 for x in scores]
    side = minimum_cut(scores, edges)
    return [s or x == 0 for s, x in zip(side, scores, strict=True)]


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """The main text's blocks in page order, joined by line ends; empty if there is none."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, content_of(blocks, weights), strict=True) if keep)


def extract(pages: DataFrame, weights: tuple[float, ...] = PRIOR) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html counts as empty; a page without main text has an empty text; an empty table gives no rows. Each
    row is judged by itself, so repeated rows, null ids and extra columns do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_text(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
