"""HTML extraction (operator 1): gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page is read into its block elements. Features of each (tag, attribute tokens of it and of its ancestors, density of
its subtree, depth, siblings, place in the page) go to boosted trees, trained here in numpy on made-up labelled
pages. Scores are decoded over the tree: of all choices in which nothing below a dropped element is kept, the one with
the best sum of scores is taken, so ancestors and descendants never contradict each other.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .html_pages import NAMES, PageMaker

#: Training: pages, trees, their depth, learning rate, bins of a feature, least weight of a leaf.
PAGES, TREES, DEPTH, RATE, BINS, LEAST_LEAF, SEED = 900, 80, 4, 0.25, 32, 4.0, 20_000
#: Pages of one prediction: bounds memory, and makes numpy calls few.
PAGE_BYTES = 1_500_000

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Their content is never text of a page.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button datalist title".split())
#: Their content is no markup: it ends at their own end tag only.
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second begins, but not beyond one of the third.
ENDS_BEFORE = {
    "p": (BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"hr"}, frozenset(("button", "table", "td", "th"))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dd": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "td": (frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "tr", "tbody", "tfoot")), frozenset(("table",))),
    "tr": (frozenset(("tr", "tbody", "tfoot")), frozenset(("table",))),
    "head": (BLOCKS - {"html"}, frozenset()),
}
_CLOSERS = {t: tuple(k for k, (by, _) in ENDS_BEFORE.items() if t in by) for t in BLOCKS | {"hr"}}
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PARTS = tuple(NAMES)
#: Tokens of attribute names by part; the more general ones of a part's names are left to the others.
TOKENS = {t: i for i, part in enumerate(PARTS) for name in NAMES[part] for t in name.split("-") if t not in ("site", "page", "list", "right", "column", "slot", "top", "more", "next", "read", "text")}
TOKENS |= {t: PARTS.index(p) for p, names in {"nav": "breadcrumb tabs dropdown", "ad": "adsense adv dfp taboola outbrain", "notice": "cookies overlay toast", "comment": "replies respond reviews", "share": "sharing sociallinks tag", "side": "secondary complementary", "header": "contentinfo logo", "content": "articlebody main postbody"}.items() for t in names.split()}
_KINDS = ({"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"div", "center"}, {"section"}, {"article"}, {"main"}, {"nav"}, {"header"}, {"footer", "address"}, {"aside"}, {"form", "fieldset", "legend", "dialog"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption", "details", "summary"}, {"body", "html"})
KIND = {t: k for k, tags in enumerate(_KINDS) for t in tags}
_N_KINDS, _N_PARTS = len(_KINDS), len(PARTS)


@dataclass
class Page:
    """Block elements in the order of their start tags (parents come first), and runs of text between block ends."""

    parent: list[int]
    kind: list[int]
    marks: list[int]  # bit set of parts that the attribute tokens name
    keep: list[int]  # data-keep of made-up pages: -1 none
    counts: list[list[int]]  # by element, without what is below: letters, in links, stops, links, inputs
    runs: list[tuple[int, str]]


def read(source: str, *, labelled: bool = False) -> Page:
    """Parse leniently: unknown, unclosed and stray tags are taken as browsers mostly do; a cut tag at the end goes.

    Only made-up pages are ``labelled``: elsewhere data-keep is an attribute like others that no feature reads.
    """
    page = Page([-1], [KIND["html"]], [0], [-1], [[0, 0, 0, 0, 0]], [])
    stack: list[tuple[str, int]] = [("html", 0)]  # (tag, element), inline elements with that of their block
    places: dict[str, list[int]] = {}  # where in the stack each tag is open, so that no search goes through it
    node, links, unseen = 0, 0, 0
    pieces: list[str] = []
    at = 0

    def flush():
        if pieces:
            # Some characters that references stand for are white space, so they are decoded first.
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                page.runs.append((node, text))
                page.counts[node][2] += text.count(".") + text.count(",") + text.count("?") + text.count("!")

    def pop():
        nonlocal node, links, unseen
        tag, _ = stack.pop()
        places[tag].pop()
        if tag in BLOCKS:
            flush()
        if tag == "a":
            links -= 1
        elif tag in UNSEEN:
            unseen -= 1
        node = stack[-1][1]

    size = len(source)
    while at < size:
        found = _TAG.search(source, at)
        start = found.start() if found else size
        if start > at and not unseen:
            piece = source[at:start]
            pieces.append(piece)
            letters = len(piece) - piece.count(" ")
            page.counts[node][0] += letters
            if links:
                page.counts[node][1] += letters
        if not found:
            break
        at = found.end()
        close, tag, inside = found.group(1), found.group(2), found.group(3)
        if tag is None:
            close, tag, inside = found.group(4), found.group(5), ""
            if tag is None or source[at - 1] != ">":
                continue
        tag = tag.lower()
        if close:
            if places.get(tag):
                while len(stack) > places[tag][-1] + 1:
                    pop()
                pop()
            continue
        for ended in _CLOSERS.get(tag, ()):
            if places.get(ended):
                depth = places[ended][-1]
                if all(not places.get(b) or places[b][-1] < depth for b in ENDS_BEFORE[ended][1]):
                    while len(stack) > depth:
                        pop()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                if tag == "br" and not unseen:
                    pieces.append(" ")
            elif tag == "input":
                page.counts[node][4] += 1
            continue
        if inside.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            flush()
            mark, keep = 0, -1
            if "=" in inside:
                for name, a, b, c in _ATTRIBUTE.findall(inside):
                    value = a or b or c
                    if name.lower() == "data-keep":
                        if labelled:
                            keep = int(value)
                        continue
                    for token in _TOKEN.findall(value):
                        part = TOKENS.get(token.lower())
                        if part is not None:
                            mark |= 1 << part
            page.parent.append(node)
            page.kind.append(KIND[tag])
            page.marks.append(mark)
            page.keep.append(keep)
            page.counts.append([0, 0, 0, 0, 0])
            node = len(page.parent) - 1
        elif tag == "a":
            links += 1
            page.counts[node][3] += 1
        elif tag in UNSEEN:
            unseen += 1
            if tag in ("button", "select", "textarea"):
                page.counts[node][4] += 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            at = end.start() if end else size
    while stack:
        if len(stack) == 1:
            flush()
            break
        pop()
    return page


def features(page: Page) -> np.ndarray:
    """A row for each block element; see the names at the end of the function."""
    n = len(page.parent)
    parent = page.parent
    own = np.array(page.counts, np.float64)
    total, items, inner = own.tolist(), [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p, a, b = parent[i], total[i], total[parent[i]]
        for k in range(5):
            b[k] += a[k]
        items[p] += items[i] + (page.kind[i] == 0)
        inner[p] += inner[i] + 1
    depth, above, begin, rank, prev, follow, alike = [0] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    high = [0] * n  # kinds of the ancestors
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | page.marks[p]
        high[i] = high[p] | 1 << page.kind[p]
        children[p].append(i)
    for p, mine in enumerate(children):
        if mine:
            kinds: dict[int, int] = {}
            seen = begin[p] + 0.0
            for c in mine:
                kinds[page.kind[c]] = kinds.get(page.kind[c], 0) + 1
            last = 0.0
            for k, c in enumerate(mine):
                begin[c] = seen
                seen += total[c][0]
                rank[c] = (k + 1) / len(mine)
                alike[c] = kinds[page.kind[c]]
                prev[c] = last
                last = total[c][0]
                if k:
                    follow[mine[k - 1]] = last
    t = np.array(total)
    parents = np.maximum(0, np.array(parent))
    kind, marks, over, ancestors = np.array(page.kind), np.array(page.marks), np.array(above), np.array(high)
    letters, whole = t[:, 0], max(1.0, total[0][0])
    numbers = np.column_stack([
        np.log1p(letters), t[:, 1] / np.maximum(1, letters), t[:, 2] / np.maximum(1, letters) * 100, np.log1p(t[:, 3]), t[:, 4], np.log1p(items), np.log1p(inner),
        letters / (1 + np.array(inner)), np.array(depth), np.array([len(c) for c in children]), np.array(rank), np.log1p(alike), np.log1p(prev), np.log1p(follow),
        letters / np.maximum(1, letters[parents]), letters / whole, np.array(begin) / whole, t[parents, 1] / np.maximum(1, letters[parents]), np.log1p(own[:, 0]), np.log1p(np.array(items)[parents]),
    ])
    bits = np.arange(_N_PARTS)
    return np.hstack([numbers, kind[:, None] == np.arange(_N_KINDS), marks[:, None] >> bits & 1, over[:, None] >> bits & 1, ancestors[:, None] >> np.arange(_N_KINDS) & 1, kind[parents][:, None] == np.arange(_N_KINDS)]).astype(np.float32)


@dataclass
class BoostedTrees:
    """Complete binary trees: (feature, threshold) of inner nodes level by level, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds that an element holds article text."""
        out, index = np.full(len(rows), self.base), np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[index, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> BoostedTrees:
    """Newton boosting of the logistic loss over binned features."""
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)])
    flat = binned + np.arange(width) * BINS
    share = np.average(labels, weights=weights)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weights * (labels - p), weights * p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
        for level in range(DEPTH):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                mine = np.flatnonzero(node == k)
                if len(mine):
                    index = flat[mine].reshape(-1)
                    gs = np.bincount(index, np.repeat(g[mine], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                    hs = np.bincount(index, np.repeat(h[mine], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                    g_all, h_all = g[mine].sum(), h[mine].sum()
                    gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
                    gain[(hs < LEAST_LEAF) | (h_all - hs < LEAST_LEAF)] = 0
                    best = int(gain.argmax())
                    f, b = divmod(best, BINS)
                    if gain.flat[best] > 1e-6 and b < len(cuts[f]):
                        feature[k], threshold[k] = f, cuts[f][b]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += value[leaf]
        trees.append((feature, threshold, value))
    return BoostedTrees(*(np.array(x) for x in zip(*trees, strict=True)), base)


def labels_of(page: Page) -> np.ndarray:
    """Of a made-up page: whether an element holds any article text."""
    inside, out = [0] * len(page.parent), np.zeros(len(page.parent), bool)
    for i in range(len(page.parent)):
        inside[i] = page.keep[i] if page.keep[i] >= 0 else inside[page.parent[i]] if i else 0
    for node, _ in page.runs:
        if inside[node] == 1:
            while node >= 0 and not out[node]:
                out[node] = True
                node = page.parent[node]
    return out


@functools.cache
def model(pages: int = PAGES, seed: int = SEED) -> BoostedTrees:
    """Trained on that many made-up pages; the same each time."""
    made = [read(PageMaker(seed + i).page(), labelled=True) for i in range(pages)]
    labels = np.concatenate([labels_of(p) for p in made]).astype(float)
    weights = np.concatenate([np.full(len(p.parent), min(1.0, 20 / len(p.parent))) for p in made])
    return boost(np.vstack([features(p) for p in made]), labels, weights)


def decode(page: Page, scores: np.ndarray) -> list[bool]:
    """The kept elements: the best sum of scores (less those of what is dropped) with ancestors of kept ones kept."""
    n = len(page.parent)
    keep = [s / 2 for s in scores.tolist()]
    drop = [-k for k in keep]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] and keep[i] > drop[i]
    return out


def extract(sources: list[str | None], trees: BoostedTrees) -> list[str]:
    """The main text of each page; pages are scored together."""
    pages = [read(s or "") for s in sources]
    scores = trees.scores(np.vstack([features(p) for p in pages])) if pages else np.empty(0)
    out, at = [], 0
    for page in pages:
        kept = decode(page, scores[at : at + len(page.parent)])
        at += len(page.parent)
        out.append("\n".join(text for node, text in page.runs if kept[node]))
    return out


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. A null or empty page, or one without article, has an empty text.

    Repeated rows come out each; other columns are not read; an empty table gives an empty result. A long page is
    read whole; pages go through a worker in batches of PAGE_BYTES, or one by one if longer.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    common.ship(spark)
    trees = spark.sparkContext.broadcast(model())
    inner = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    schema = inner.select("page_id", "url").schema.add("text", "string", False).add("n_chars", "long", False)

    def run(record_batches):
        with common.worker_memory():
            for batch in common.batches(record_batches, "html", PAGE_BYTES):
                texts = extract(batch.column(2).to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return inner.mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
