"""Main text of pages by minimum cuts.

A page's text blocks are labelled content or boilerplate at once, by the cut of least cost between
the two: a block cut from the label that the classifier prefers costs the difference of the two
labels' log-likelihoods, and blocks that are neighbours in the page, or share a container of its
tree, cost something where they are labelled unlike. The cut is a maximum flow.

The classifier has two parts. What a block's place says (elements such as article or nav, and names in
class, id and role of the elements around it) are fixed weights. What its words say (how many, how many in links,
whether they end a sentence, phrases of notices) is a logistic regression that is fitted here, on the
blocks whose place is certain: one pass over all pages counts them per cell of those features, and
the few hundred cells are all that the fit and the driver see. The fit starts from stated weights and falls back
on them where no place is certain.

Defined results: null html is an empty page. A page without content has the text "" and 0 characters.
White space is what Unicode calls so, the no-break space included. Character references are decoded as HTML does, those without a semicolon
too. Headings of an article belong to it; titles in a page's head don't. Null and repeated ids and urls are rows like
others; equal pages have equal texts. Pages of any length are read whole. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hippolake.llm.html_blocks import HEADINGS, Block, Reader

#: Elements and roles that say what their texts are, and how sure that is.
CONTENT_TAGS = {"article": 8.0, "main": 3.0}
BOILERPLATE_TAGS = {"nav": 8.0, "footer": 8.0, "aside": 8.0, "form": 8.0, "menu": 8.0, "dialog": 8.0, "search": 8.0, "fieldset": 8.0, "header": 8.0}
ROLES = {"main": "main", "article": "article", "navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog", "menu": "nav", "menubar": "nav"}
#: Words of class and id names. WRAPPERS say that a name speaks of a layout, not of what is in it.
CONTENT_NAMES = set("article content story post entry body text maintext prose main".split())
BOILERPLATE_NAMES = set(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising advertorial banner banners sponsor sponsored sponsors promo promos promoted promotion "
    "cookie cookies consent gdpr notice notices notification alert alerts disclaimer popup modal overlay toast "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc "
    "sidebar sidebars aside rail footer foot colophon copyright masthead header topbar "
    "comment comments commentlist discussion disqus respond replies reply "
    "form login signin signup register search searchbox newsletter subscribe subscription "
    "share sharing social follow related recommended recommendations trending popular widget widgets skip toolbar".split()
)
WRAPPERS = set("wrap wrapper wrapped container layout page site has with no without grid row col columns outer inner main".split())
#: Inside an article these speak of its title or its own notes, which aren't boilerplate.
OF_ARTICLES = {"header", "banner", "masthead"}
#: An article or main inside these is still the page's own.
OPEN_TO_ARTICLES = {"form", "fieldset", "header", "banner", "masthead", "notice", "alert", "overlay", "modal", "page"}

#: Phrases of notices, in texts of at most NOTICE_WORDS words.
PHRASES = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|newsletter|sign (?:in|up)|log ?in|privacy|terms of|advertis|sponsored|share (?:this|on)|follow us|read more|related|comment|repl(?:y|ies)|click here|javascript", re.I)
NOTICE_WORDS = 40
SENTENCE_ENDS = tuple(".!?…:;\"'”’»)。！？")

#: Weights of (1, words outside links in powers of two, share in links, ends a sentence, notice phrases) from which the fit starts, and how firmly: as if each had variance 1.
FIRST_WEIGHTS = (-1.5, 0.6, -4.0, 1.0, -2.0)
#: The fit weighs all its blocks as so many at most, half of them content; what words say is held within MOST_SAID.
FIT_WEIGHT, MOST_SAID = 2000.0, 4.0
WORD_STEPS, LINK_STEPS = 12, 4
#: Cost of unlike labels: neighbours in one container, neighbours in two, a block and its container, a container and the one around it.
NEXT, NEXT_APART, INSIDE, WITHIN = 1.0, 0.5, 0.5, 0.25
#: Characters of texts handed on at once.
HELD = 8_000_000


@dataclass(frozen=True)
class Place:
    """What is known of a place: its cost in favour of content (less than 0: boilerplate), whether inner articles can change it, whether it's in an article."""

    says: float = 0.0
    closed: bool = False
    in_article: bool = False


_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
NOWHERE = Place()


def _named(found: dict[str, str]) -> tuple[set[str], bool]:
    """Boilerplate words of class and id, and whether they name content instead; names of layouts say neither."""
    bad, good = set(), False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name)} | {name.lower()}
        if words & BOILERPLATE_NAMES and not (words & WRAPPERS and len(words) > 2):
            bad |= words & BOILERPLATE_NAMES
        elif words & CONTENT_NAMES:
            good = True
    return bad, good


def place(above: Place | None, tag: str, found: dict[str, str]) -> Place:
    """What an element's place is, in a place `above`."""
    if above is None:
        return NOWHERE
    if tag in ("html", "body"):
        return above
    tag = ROLES.get(found.get("role", "").strip().lower(), tag) if found else tag
    hidden = bool(found) and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").lower().replace(" ", ""))
    bad, good = _named(found) if found else (set(), False)
    if tag in HEADINGS or tag == "p":
        good = False
    if tag in BOILERPLATE_TAGS:
        bad = bad | {tag}
    if above.in_article:
        bad = bad - OF_ARTICLES
    if above.closed:
        return above
    if bad or hidden:
        return Place(-8.0, closed=hidden or not bad <= OPEN_TO_ARTICLES, in_article=above.in_article)
    if tag in CONTENT_TAGS:
        return Place(max(CONTENT_TAGS[tag], above.says), in_article=True)
    if good and above.says >= 0:
        return Place(max(4.0, above.says), in_article=above.in_article)
    return above


def blocks_of(page: str | None) -> tuple[list[Block], list[int]]:
    """The page's text blocks in order, and the parent of each of its containers."""
    reader = Reader(place).read(page or "")
    return reader.blocks, reader.parents


def cell_of(block: Block) -> int:
    """The block's cell among the features of its words."""
    steps = min(WORD_STEPS, int(block.words * (1 - block.link_share)).bit_length())
    ends = block.text.endswith(SENTENCE_ENDS)
    notice = block.words <= NOTICE_WORDS and PHRASES.search(block.text) is not None
    return ((steps * (LINK_STEPS + 1) + int(block.link_share * LINK_STEPS)) * 2 + ends) * 2 + notice


CELLS = (WORD_STEPS + 1) * (LINK_STEPS + 1) * 4


def features() -> np.ndarray:
    """Features of each cell, a row a cell."""
    cell = np.arange(CELLS)
    return np.stack([np.ones(CELLS), cell // 4 // (LINK_STEPS + 1), cell // 4 % (LINK_STEPS + 1) / LINK_STEPS, cell // 2 % 2, cell % 2], axis=1).astype(float)


def fit_cells(content: np.ndarray, boilerplate: np.ndarray) -> np.ndarray:
    """Log-odds of content of each cell, from the cells' counts of certain blocks.

    Newton's method on the logistic likelihood and a normal prior around FIRST_WEIGHTS.
    """
    x, first = features(), np.array(FIRST_WEIGHTS)
    total = min(FIT_WEIGHT, float(content.sum() + boilerplate.sum()))
    share = [c * (total / 2 / c.sum()) if c.sum() else c * 0.0 for c in (content.astype(float), boilerplate.astype(float))]
    if not (content.sum() and boilerplate.sum()):
        share = [s * 0.0 for s in share]
    weights = first.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share[0] * (1 - p) - share[1] * p) - (weights - first)
        curve = (x * ((share[0] + share[1]) * p * (1 - p))[:, None]).T @ x + np.eye(len(first))
        step = np.linalg.solve(curve, slope)
        weights = weights + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return np.clip(x @ weights, -MOST_SAID, MOST_SAID)


def fit(pages: DataFrame) -> np.ndarray:
    """Log-odds of each cell, learned from all pages (column html)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            for page in batch.column(0):
                for block in blocks_of(page.as_py())[0]:
                    if abs(block.place.says) >= 8.0:
                        seen[int(block.place.says < 0), cell_of(block)] += 1
        met = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[0, met]), pa.array(seen[1, met])], ["cell", "content", "boilerplate"])

    sums = pages.select("html").mapInArrow(counted, "cell int, content long, boilerplate long").groupBy("cell").agg(F.sum("content").alias("content"), F.sum("boilerplate").alias("boilerplate")).collect()
    counts = np.zeros((2, CELLS), np.int64)
    for r in sums:
        counts[:, r.cell] = r.content, r.boilerplate
    return fit_cells(*counts)


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content in the labelling of least cost.

    costs: what labelling a node boilerplate costs more than content. edges: (a, b, cost of unlike
    labels). Nodes whose own cost exceeds all their edges together have that label in every least
    labelling; they are settled first, and what they say becomes part of their neighbours' costs. The
    rest is a maximum flow, by shortest augmenting paths in levels. Of equal costs, boilerplate.
    """
    n = len(costs)
    own = list(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    open_cost = [0.0] * n
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
        open_cost[a] += c
        open_cost[b] += c
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is not None or abs(own[i]) <= open_cost[i] + 1e-9 and near[i]:
            continue
        label[i] = own[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                own[j] += c if label[i] else -c
                open_cost[j] -= c
                waiting.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        at = {i: k for k, i in enumerate(left)}
        inner = [(at[a], at[b], c) for a, b, c in edges if label[a] is None and label[b] is None]
        for i, found in zip(left, max_flow([own[i] for i in left], inner), strict=True):
            label[i] = found
    return [bool(x) for x in label]


def max_flow(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut: source to nodes of positive cost, nodes of negative cost to the sink."""
    n = len(costs)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            join(source, i, c, 0.0)
        elif c < 0:
            join(i, sink, -c, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        waiting = deque([source])
        while waiting:
            a = waiting.popleft()
            for e in head[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    waiting.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                first = len(path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= 1e-9 and k < first:
                        first = k
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while tried[a] < len(head[a]):
                e = head[a][tried[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(head[a]):
                path.append(head[a][tried[a]])
                a = to[path[-1]]
            elif path:
                back = path.pop()
                a = to[back ^ 1]
                tried[a] += 1
            else:
                break


def graph_of(blocks: list[Block], parents: list[int], said: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs and edges: a node a block, then a node a container that holds blocks of two or more parts."""
    costs = [block.place.says + float(said[cell_of(block)]) for block in blocks]
    edges = []
    for i in range(1, len(blocks)):
        edges.append((i - 1, i, NEXT if blocks[i - 1].container == blocks[i].container else NEXT_APART))
    node: dict[int, int] = {}
    for i, block in enumerate(blocks):
        inner, outer, cost = i, block.container, INSIDE
        while outer >= 0:
            known = outer in node
            if not known:
                node[outer] = len(costs)
                costs.append(0.0)
            edges.append((inner, node[outer], cost))
            if known:
                break
            inner, outer, cost = node[outer], parents[outer], WITHIN
    return costs, edges


def main_text(page: str | None, said: np.ndarray) -> str:
    """The page's content blocks, joined by blanks."""
    blocks, parents = blocks_of(page)
    content = minimum_cut(*graph_of(blocks, parents, said))
    return " ".join(block.text for block, kept in zip(blocks, content[: len(blocks)], strict=True) if kept)


def extract(pages: DataFrame, said: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html). `said` is what fit() gives; it is fitted on the pages if absent."""
    said = fit(pages) if said is None else said
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, held = 0, [], 0
            for i, page in enumerate(batch.column("html")):
                texts.append(main_text(page.as_py(), said))
                held += len(texts[-1])
                if held >= HELD or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])
                    first, texts, held = i + 1, [], 0

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
