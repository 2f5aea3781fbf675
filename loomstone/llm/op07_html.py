"""Main text of pages by minimum-cut labelling of blocks.

A page is read into blocks of text with their chains of enclosing elements. Each block gets a cost, in log odds, for
either label, made of two kinds of evidence that know nothing of each other: what its text looks like (length, share of
links, end of a sentence, kind of element), weighed by a logistic classifier and no surer than SURE, and what the
elements around it are called (article and main against nav, footer, aside, forms, adverts, comments), MARKED strong.
The costs are its capacities to the terminals content and boilerplate. Blocks next to each other and blocks under one
parent are tied by smoothness edges, which weigh the log odds that such a pair has one label, by the distance in the
DOM. The minimum cut separates content from boilerplate; it turns blocks whose own evidence is weaker than their
neighbours' (a paragraph of one word among paragraphs, a line of text among links). Blocks that no edges can turn are
settled first, which leaves the cut as it is; Dinic's max-flow decides the rest.

The classifier and the edges are fitted on the SAMPLE distinct pages of least hash (all their blocks, counted on the
executors by their few possible feature values, so what comes to the driver is bounded). Labels of the fit are the
marked blocks: names of elements are no feature of the text classifier, so it learns what marked text looks like and
speaks for text that nothing marks. Its weights are held near PRIOR, which also serves pages without any marks.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by two newlines; nothing else is dropped or cut.

Defined cases: null or empty html gives ''; text outside any element is a block of its own; unclosed and stray tags,
comments and quotes end where HTML lets them end, or with the page (only script, style, textarea, title and the like
swallow what follows them; other elements without an end tag, such as svg or object, hide nothing); repeated rows get
equal results; an empty table gives an empty result; other columns are ignored by the query.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table

SAMPLE, SURE, MARKED, WEAKER, LEAST_EDGE, MOST_EDGE, FAR = 200, 3.0, 4.0, 0.5, 0.1, 2.0, 3
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SWALLOWS = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("template object svg canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("noscript address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset search legend noscript".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset("nav navbar navigation menu menubar sidebar aside footer foot masthead ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing social follow related recommended recommendations trending popular breadcrumb breadcrumbs crumbs pagination pager toolbar widget widgets search skip copyright legal disclaimer paywall toc tags".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion responses reviews".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FEATURES = ("bias", "log words", "link share", "sentence end", "heading", "list item", "paragraph", "short")
PRIOR = np.array([-0.4, 0.45, -4.0, 0.8, 0.3, -0.8, 0.9, -0.5])


class Node:
    __slots__ = ("tag", "parent", "kind", "number")

    def __init__(self, tag: str, parent: Node | None, kind: frozenset, number: int):
        self.tag, self.parent, self.kind, self.number = tag, parent, kind, number


def _kind(tag: str, attributes: str) -> frozenset:
    found = set()
    if tag in BOILER_TAGS:
        found.add("boiler")
    elif tag in CONTENT_TAGS:
        found.add("content")
    elif tag == "header":
        found.add("header")
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                if words & COMMENT_WORDS:
                    found.add("comment")
                if words & BOILER_WORDS and tag not in CONTENT_TAGS:
                    found.add("boiler")
                elif words & {"header"} and tag not in CONTENT_TAGS:
                    found.add("header")
                if words & CONTENT_WORDS:
                    found.add("word")
            elif name == "role":
                if value.lower() in BOILER_ROLES:
                    found.add("boiler")
                elif value.lower() in ("main", "article"):
                    found.add("content")
            elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (name == "aria-hidden" and value.lower() == "true"):
                found.add("boiler")
    return frozenset(found)


_NONE = frozenset()


_HEAD_END = re.compile(r"</head\s*>|<body[\s>]", re.I)


@cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/>]", re.I)


def _closed(page: str, tag: str) -> dict[int, int]:
    """Where each element of the tag that has an end tag begins and ends."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])[^>]*>", page, re.I | re.S):
        if m[1] == "":
            if not m[0].endswith("/>"):
                stack.append(m.start())
        elif m[1] == "/" and stack:
            out[stack.pop()] = m.end()
    return out


def blocks(page: str) -> list[tuple[str, float, Node]]:
    """(text, share of its characters in links, enclosing block element) in page order."""
    out: list[tuple[str, float, Node]] = []
    node = Node("", None, _NONE, 0)
    count, pieces, linked, in_link, at, end = 1, [], 0, 0, 0, len(page)
    closed: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            if text:
                out.append((text, min(1.0, linked / len(text)), node))
        pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)

    while at < end:
        i = page.find("<", at)
        if i < 0:
            say(page[at:])
            break
        say(page[at:i])
        m = TOKEN.match(page, i)
        if m is None:
            if re.match(r"</?[a-zA-Z]|<[!?]", page[i : i + 3]):  # a tag with a stray quote, or cut off
                j = page.find(">", i)
                if j < 0:
                    break
                m = re.match(r"<(/?)([a-zA-Z!?][^\s/>]*)([^>]*)>", page[i : j + 1], re.S)
                at = j + 1
                if m is None:
                    continue
            else:
                say("<")
                at = i + 1
                continue
        else:
            at = m.end()
        if m[2] is None or not m[2][0].isalpha():
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "br" or tag == "wbr":
            say(" " if tag == "br" else "")
        elif tag == "head":
            if not closing:
                c = _HEAD_END.search(page, at)
                at = at if c is None else c.end() if c[0].startswith("</") else c.start()
        elif tag in SWALLOWS:
            if not closing:
                c = _ends(tag).search(page, at)
                at = end if c is None else c.end()
        elif tag in HIDDEN:
            if not closing and not m[3].endswith("/"):
                if tag not in closed:
                    closed[tag] = _closed(page, tag)
                at = closed[tag].get(i, at)
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCK:
            flush()
            if closing:
                n = node
                while n is not None and n.tag != tag:
                    n = n.parent
                if n is not None and n.parent is not None:
                    node = n.parent
                if tag not in ("p", "div", "li"):
                    in_link = 0
            elif tag != "hr":
                if tag in CLOSES_P and node.tag == "p":
                    node = node.parent
                if tag in CLOSED_BY:
                    which, until = CLOSED_BY[tag]
                    n = node
                    while n.parent is not None and n.tag not in which and n.tag not in until:
                        n = n.parent
                    while n.parent is not None and n.tag in which:
                        node = n = n.parent
                node = Node(tag, node, _kind(tag, m[3]), count)
                count += 1
    flush()
    return out


def features(text: str, share: float, node: Node) -> tuple[float, ...]:
    """What the text looks like, in few different values."""
    words = text.count(" ") + 1
    tag = node.tag
    return (
        1.0, 0.7 * min(8, words.bit_length()), round(share * 10) / 10, float(text[-1] in ".!?…。！？:;\"”»)"),
        float(tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(tag in ("li", "dd", "dt", "option")), float(tag in ("p", "blockquote", "pre")), float(words < 4),
    )


def marks(node: Node) -> float:
    """Evidence of the elements around a block: 1 content, -1 boilerplate, WEAKER for hints, 0 none. Comments count wherever they are, else the nearest mark."""
    heading, found, hint = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), 0.0, 0.0
    n: Node | None = node
    while n is not None:
        k = n.kind
        if k:
            if "comment" in k:
                return -1.0
            if not found:
                if "boiler" in k:
                    found = -1.0
                elif "content" in k:
                    found = 1.0
                elif "header" in k and not heading:
                    found = -WEAKER
            if "word" in k:
                hint = WEAKER
        n = n.parent
    return found or hint


def distance(a: Node, b: Node) -> int:
    """Steps between two elements in the DOM beyond those of siblings, from 1 to FAR; 1 also within one element."""
    above, n, steps = {}, a, 0
    while n is not None and steps <= FAR + 1:
        above[id(n)] = steps
        n, steps = n.parent, steps + 1
    m, down = b, 0
    while m is not None and down <= FAR + 1:
        if id(m) in above:
            return min(FAR, max(1, above[id(m)] + down - 1))
        m, down = m.parent, down + 1
    return FAR


def ties(nodes: list[Node]) -> Iterator[tuple[int, int, int]]:
    """(i, j, kind) of blocks to be tied: kind 1 to FAR for neighbours in page order by their distance, 0 for the nearest block before under the same parent that is no neighbour."""
    last: dict[int, int] = {}
    for i, node in enumerate(nodes):
        if i:
            yield i - 1, i, distance(nodes[i - 1], node)
        parent = node.parent.number if node.parent is not None else -1
        if last.get(parent, i - 1) < i - 1:
            yield last[parent], i, 0
        last[parent] = i


@dataclass(frozen=True)
class Model:
    """Weights of the text's features, and of edges by kind (0 for siblings, 1 to FAR for neighbours)."""

    weights: np.ndarray
    edges: tuple[float, ...]


DEFAULT = Model(PRIOR, (0.5, 1.0, LEAST_EDGE, LEAST_EDGE))


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |gain| of mislabelled nodes and of the weights of edges between labels.

    gain > 0 is what it costs to call a node boilerplate, -gain what it costs to call it content; a tie is boilerplate."""
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # settle what its edges cannot turn
        i = todo.pop()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, content in zip(rest, _source_side(rest, gain, near)):
            label[i] = content
    return [bool(x) for x in label]


def _source_side(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's max-flow between the terminals; which nodes the source still reaches afterwards."""
    place = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def join(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for i in nodes:
        if gain[i] > 0:
            join(source, place[i], gain[i], 0.0)
        elif gain[i] < 0:
            join(place[i], sink, -gain[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                join(place[i], place[j], w, w)
    while True:
        level = [-1] * len(out)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        at = [0] * len(out)
        path: list[int] = []  # edges from the source on
        while True:
            u = to[path[-1]] if path else source
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path = path[: next(k for k, e in enumerate(path) if room[e] <= 1e-12)]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    break
                at[u] += 1
            else:
                if not path:
                    break
                at[to[path.pop() ^ 1]] += 1


def labelling(found: list[tuple[str, float, Node]], model: Model) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Gains and edges of a page's blocks."""
    text = np.clip(np.array([features(*b) for b in found]) @ model.weights, -SURE, SURE)
    gain = (text + MARKED * np.array([marks(b[2]) for b in found])).tolist()
    return gain, [(i, j, model.edges[kind]) for i, j, kind in ties([b[2] for b in found])]


def content(page: str, model: Model = DEFAULT) -> list[str]:
    """The texts of the blocks that the cut leaves with content."""
    found = blocks(page)
    return [b[0] for b, keep in zip(found, minimum_cut(*labelling(found, model))) if keep] if found else []


def counts(page: str) -> dict[tuple, int]:
    """How often each (features, label) of marked blocks and each (edge kind, same label) of pairs of them stands on a page."""
    out: dict[tuple, int] = {}
    found = blocks(page)
    label = [m if abs(m) == 1.0 else 0.0 for m in (marks(b[2]) for b in found)]
    for b, y in zip(found, label):
        if y:
            key = ("block", *features(*b), float(y > 0))
            out[key] = out.get(key, 0) + 1
    for i, j, kind in ties([b[2] for b in found]):
        if label[i] and label[j]:
            key = ("pair", float(kind), float(label[i] == label[j]))
            out[key] = out.get(key, 0) + 1
    return out


def fitted(seen: dict[tuple, int], pull: float = 2.0) -> Model:
    """Weights near PRIOR by Newton steps, edges as smoothed log odds of one label, between LEAST_EDGE and MOST_EDGE."""
    w = PRIOR.copy()
    rows = [(k[1:-1], k[-1], n) for k, n in sorted(seen.items()) if k[0] == "block"]
    if rows:
        x, y, n = (np.array(c, float) for c in zip(*rows))
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (p - y)) + pull * (w - PRIOR)
            w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), g)
    edges = []
    for kind in range(FAR + 1):
        same, other = seen.get(("pair", float(kind), 1.0), 0), seen.get(("pair", float(kind), 0.0), 0)
        edges.append(float(np.clip(math.log((same + 1) / (other + 1)), LEAST_EDGE, MOST_EDGE)) if same + other else DEFAULT.edges[kind])
    for kind in range(2, FAR + 1):  # no pair is tied more than a nearer one
        edges[kind] = min(edges[kind], edges[kind - 1])
    return Model(w, tuple(edges))


def fit(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the `sample` distinct pages of least hash."""
    h = F.xxhash64("html")
    some = pages.filter(F.col("html").isNotNull()).select("page_id", "html", h.alias("h"))
    least = some.groupBy("h").agg(F.min(F.coalesce(F.col("page_id").cast("long"), F.lit(-1))).alias("least")).orderBy("h").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple, int] = {}
            for page in b.column(0).to_pylist():
                for k, n in counts(page).items():
                    out[k] = out.get(k, 0) + n
            yield pa.record_batch([pa.array([k[0] for k in out], pa.string()), pa.array([list(k[1:]) for k in out], pa.list_(pa.float64())), pa.array(list(out.values()), pa.int64())], ["kind", "key", "n"])

    chosen = some.join(F.broadcast(least), "h").filter(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)) == F.col("least"))  # `sample` rows are broadcast
    rows = chosen.select("html").mapInArrow(run, "kind string, key array<double>, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    return fitted({(r["kind"], *r["key"]): r["n"] for r in rows})


def extracted(pages: DataFrame, model: Model = DEFAULT) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n\n".join(content(h, model)) if h else "" for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))
