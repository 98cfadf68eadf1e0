"""Main text of web pages: content marginals of a tree-structured graphical model over the blocks of a page."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, rows_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|(</?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"<]*+"|'[^'<]*+')*+)>|(</?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var br wbr img".split()
)
CLOSED_BY_BLOCK = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
SCOPE = frozenset("article aside body blockquote button caption div footer form header html li main nav section table td th".split())
#: What is never read.
UNREAD = RAW | {"button", "head", "option", "object", "canvas", "audio", "video", "datalist"}
#: What names of elements, classes and ids say before any page was seen.
CONTENT_TAGS = frozenset("article main p h1 h2 h3 h4 blockquote pre".split())
SIDE_TAGS = frozenset("nav footer aside form fieldset header menu dialog".split())
SIDE_NAMES = frozenset(
    "ad ads advert advertisement aside banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disclaimer discussion footer form header menu modal nav navbar navigation newsletter notice outbrain overlay pager pagination popup promo "
    "promoted recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe tags toolbar widget".split()
)
CONTENT_NAMES = frozenset("article content entry main".split())
#: Elements that only wrap: content may begin below one that is not content itself.
WRAPPERS = frozenset("#page html body div section center table tbody tr td".split())
#: How far one learned mark may move a node, and how far a name that says what a part is for.
LEARNED, NAMED = 2.0, 30.0


@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset[str]
    words: int = 0
    linked: int = 0
    stops: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: text of each block in page order, with its node
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The block elements of a page as a tree, parents before children, and the text between block borders.

    Unclosed elements end as browsers end them; elements without an end run to the end of the page.
    """
    page = Page([Node("#page", -1, frozenset())])
    stack: list[tuple[str, int]] = [("#page", 0)]
    text: list[str] = []
    linked = links = unread = 0

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            if said:
                node = page.nodes[stack[-1][1]]
                n = said.count(" ") + 1
                node.words += n
                node.linked += min(n, linked)
                node.stops += sum(map(said.count, ".!?,;"))
                page.blocks.append((stack[-1][1], said))
            text.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, unread
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag not in INLINE:
                flush()
            stack.pop()
            links -= tag == "a"
            unread -= tag in UNREAD

    def close(tags: frozenset[str], borders: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                pop_to(k)
                return
            if stack[k][0] in borders:
                return

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not unread:
            said = html.unescape(raw)
            text.append(said)
            if links:
                linked += len(said.split())

    at = 0
    while True:
        m = TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        head, name, rest = (m[1], m[2], m[3]) if m[1] else (m[4], m[5], m[6])
        if not head:
            continue
        tag = name.lower()
        if head == "</":
            if tag == "br":
                say(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                if tag == "hr":
                    close(frozenset({"p"}), SCOPE)
                    flush()
                else:
                    say(" ")
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in CLOSED_BY_BLOCK:
            close(*CLOSED_BY_BLOCK[tag])
        else:
            close(frozenset({"p"}), SCOPE)
        flush()
        names = frozenset(n.lower() for _, v in ATTRIBUTE.findall(rest) for n in NAME.findall(v)) if "=" in rest else frozenset()
        page.nodes.append(Node(tag, stack[-1][1], names))
        stack.append((tag, len(page.nodes) - 1))
        unread += tag in UNREAD
    pop_to(1)
    flush()
    return page


def is_side(n: Node) -> bool:
    """Whether the element or its names say that it is no part of the article."""
    return n.tag in SIDE_TAGS or bool(n.names & SIDE_NAMES) and not n.names & CONTENT_NAMES


def edge_kind(parent: Node) -> str:
    return "open" if parent.tag in WRAPPERS and not is_side(parent) else "closed"


def features(node: Node) -> list[str]:
    """The categorical marks of a node; names go to a fixed number of buckets."""
    tag = f"tag {node.tag if node.tag.isascii() and len(node.tag) < 12 else 'other'}"
    out = [tag, *(f"name {zlib.crc32(n.encode()) % 4096}" for n in node.names)]
    if node.words:
        share = node.linked / node.words
        out += [f"size {min(6, node.words.bit_length())}", f"links {int(share * 4)}", f"stops {min(3, node.stops.bit_length())}"]
    return out


def is_side(n: Node) -> bool:
    """Whether the element or its names say that it is no part of the article."""
    return n.tag in SIDE_TAGS or bool(n.names & SIDE_NAMES) and not n.names & CONTENT_NAMES


def edge_kind(parent: Node) -> str:
    return "open" if parent.tag in WRAPPERS and not is_side(parent) else "closed"


def features(node: Node) -> list[str]:
    """The categorical marks of a node; names go to a fixed number of buckets."""
    share = node.linked / node.words if node.words else 0.0
    return [
        f"tag {node.tag if node.tag.isascii() and len(node.tag) < 12 else 'other'}",
        f"size {min(6, node.words.bit_length())}",
        f"links {int(share * 4)}" if node.words else "links -",
        f"stops {min(3, node.stops.bit_length())}" if node.words else "stops -",
        *(f"name {zlib.crc32(n.encode()) % 4096}" for n in node.names),
    ]


def weak_labels(page: Page) -> list[int] | None:
    """Content (1) or not of each node of a page that marks its article; None for pages that don't.

    Inside the article, parts that are marked as something else by their element or names are not content.
    """
    if not any(n.tag in ("article", "main") for n in page.nodes):
        return None
    out = []
    for n in page.nodes:
        above = out[n.parent] if n.parent >= 0 else 0
        out.append(0 if is_side(n) else 1 if n.tag in ("article", "main") else above)
    return out


@dataclass
class Model:
    """Log potentials: what each mark adds for content, and of a child's state given its parent's and its kind."""

    marks: dict[str, float]
    edges: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    @staticmethod
    def fit(counts: dict[str, tuple[float, float]]) -> Model:
        """From counts of ``mark`` and ``edge kind parent`` by state, over pseudo-counts for what was not seen."""
        marks: dict[str, list[float]] = {}
        edges = {"open": [[40.0, 20.0], [3.0, 60.0]], "closed": [[60.0, 0.06], [3.0, 60.0]]}
        for tag in CONTENT_TAGS:
            marks[f"tag {tag}"] = [2.0, 20.0]
        for tag in SIDE_TAGS:
            marks[f"tag {tag}"] = [50.0, 0.0]
        for name in CONTENT_NAMES:
            marks[f"name {zlib.crc32(name.encode()) % 4096}"] = [2.0, 20.0]
        for mark, row in counts.items():
            if mark.startswith("edge "):
                _, kind, state = mark.split(" ")
                got = edges[kind][int(state)]
            else:
                got = marks.setdefault(mark, [0.0, 0.0])
            got[0] += row[0]
            got[1] += row[1]
        totals: dict[str, list[float]] = {}
        for m, row in marks.items():
            t = totals.setdefault(m.split(" ")[0], [1.0, 1.0])
            t[0] += row[0]
            t[1] += row[1]
        weights = {}
        for m, (other, content) in marks.items():
            t = totals[m.split(" ")[0]]
            w = math.log((content + 1) / (t[1] + 1)) - math.log((other + 1) / (t[0] + 1))
            weights[m] = max(-LEARNED, min(LEARNED, w))
        logs = {
            kind: tuple(tuple(math.log(v / sum(row)) for v in row) for row in table)  # each row is a distribution
            for kind, table in edges.items()
        }
        return Model(weights, logs)  # type: ignore[arg-type]

    def own(self, n: Node) -> float:
        """The log odds of content by the node itself."""
        if is_side(n):
            return -NAMED
        return sum(self.marks.get(m, 0.0) for m in features(n)) + (NAMED / 3 if n.tag in ("article", "main") else 0.0)

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node: one pass of messages up the tree, one down."""
        nodes = page.nodes
        own = [[0.0, self.own(n)] for n in nodes]
        kinds = [self.edges[edge_kind(n)] for n in nodes]
        up: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            a, b = own[k]  # own potential and all messages of the children
            (e00, e01), (e10, e11) = kinds[nodes[k].parent]
            up[k] = (_log_sum(e00 + a, e01 + b), _log_sum(e10 + a, e11 + b))
            p = own[nodes[k].parent]
            p[0] += up[k][0]
            p[1] += up[k][1]
        belief = [(0.0, 0.0)] * len(nodes)
        belief[0] = (own[0][0] + math.log(0.8), own[0][1] + math.log(0.2))
        for k in range(1, len(nodes)):
            a, b = belief[nodes[k].parent]
            (e00, e01), (e10, e11) = kinds[nodes[k].parent]
            a, b = a - up[k][0], b - up[k][1]  # the parent without this child
            c, d = _log_sum(a + e00, b + e10) + own[k][0], _log_sum(a + e01, b + e11) + own[k][1]
            top = max(c, d)
            belief[k] = (c - top, d - top)
        return [1 / (1 + math.exp(min(700.0, a - b))) for a, b in belief]


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def fit(pages: DataFrame) -> Model:
    """Counts over every page that marks its article; what reaches the driver is one row per mark."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for source in b.column(0).to_pylist():
                page = parse(source or "")
                labels = weak_labels(page)
                if labels is None:
                    continue
                own: Counter = Counter()
                for n, label in zip(page.nodes, labels):
                    own.update((m, label) for m in features(n))
                    if n.parent >= 0:
                        own[f"edge {edge_kind(page.nodes[n.parent])} {labels[n.parent]}", label] += 1
                # a page speaks once, however often it repeats itself
                seen.update({k: 1 + math.log2(v) for k, v in own.items()})
            marks = sorted({m for m, _ in seen})
            return pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.string()), *(pa.array([float(seen[m, s]) for m in marks], pa.float64()) for s in (0, 1))],
                names=["mark", "other", "content"],
            )

        return one

    counts = by_batch(pages.select(F.col("html").cast("string")), make, "mark string, other double, content double")
    rows = counts.groupBy("mark").agg(F.sum("other").alias("other"), F.sum("content").alias("content")).collect()
    return Model.fit({r["mark"]: (r["other"], r["content"]) for r in rows})


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, blocks`` of every row of ``pages``: the blocks whose node is content by its marginal,
    joined by line ends, and all blocks with their marginals.

    Null or empty ``html`` has no text. Repeated rows are extracted alike; a page without blocks or
    without content gives the empty text. Columns besides ``page_id, url, html`` are left out. Without a
    ``model``, one is fitted on the same pages.
    """
    model = model or fit(pages)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, blocks = [], []
            for source in rows_of(b, "html"):
                page = parse(source or "")
                content = model.marginals(page) if page.blocks else []
                texts.append("\n".join(said for k, said in page.blocks if content[k] >= 0.5))
                blocks.append([{"content": content[k], "block": said} for k, said in page.blocks])
            kind = pa.list_(pa.struct([("content", pa.float64()), ("block", pa.string())]))
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(blocks, kind)], names=["page_id", "url", "text", "blocks"]
            )

        return one

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return by_batch(read, make, "page_id long, url string, text string, blocks array<struct<content: double, block: string>>")
