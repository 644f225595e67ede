"""Main text of web pages by minimum-cut labelling of text blocks."""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by what they do.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav object ol optgroup option p pre search section "
    "select summary table tbody td textarea tfoot th thead tr ul".split()
)
SKIPPED_TAGS = frozenset("head title script style noscript template svg annotation annotation-xml canvas iframe object audio video textarea select option datalist map".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset search address".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu submenu sidebar aside footer masthead topbar banner ad ads adv advert adverts advertisement advertisements adsense sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist disqus reply replies respond widget "
    "toolbar login search copyright disclaimer legal hidden skip tags toc rail byline teaser outbrain taboola feedback discussion".split()
)
HEADER_WORDS = frozenset("header head".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>?"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_NONE: dict[str, str] = {}

#: Words that say no more than that the element is a box of something.
GENERIC_WORDS = frozenset(
    "box block section widget container wrapper wrap inner outer area list lists item items link links bar row col column group panel pane module unit text body content title header "
    "head top bottom left right main post posts article articles story stories news button buttons icon icons form slot zone label js with has no is free e g the id".split()
)
HEAD_TAGS = frozenset("head title base link meta style script noscript template".split())

# Costs in log odds: signs of the container besides the classifier of the block itself.
HARD = 12.0  # elements and roles that hold no article by their definition
LOOSE, FAINT = 5.0, 1.5  # class or id words: nothing but such words, or with others
OUTSIDE = 2.5
INSIDE = 2.0
ADJACENT, SIBLING, ACROSS = 0.8, 0.6, 0.1

FEATURES = ("log_words", "linked", "stop", "paragraph", "heading", "item", "cell", "rights")
#: Log odds of each feature before any page is seen, the constant last; what is fitted is drawn toward them.
PRIOR = np.array([0.65, -4.0, 0.5, 0.8, 1.0, 0.0, 0.0, -1.5, -1.2])
#: Pages that the block classifier is fitted on, at most, and blocks of one; weight of the prior in blocks.
FIT_PAGES, FIT_BLOCKS, PRIOR_WEIGHT = 500, 200, 100.0


@dataclass(slots=True)
class _Node:
    tag: str
    up: _Node | None
    skip: bool
    boiler: float
    main: bool
    in_link: bool
    key: int
    loose: float = 0.0
    holds: bool = False


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    node: _Node


def _judge(tag: str, attrs: str, up: _Node) -> tuple[float, bool, float]:
    """(strength of signs for boilerplate, opens main text, cost of class or id words for boilerplate) of an element by itself."""
    boiler, main, loose = 0.0, tag in MAIN_TAGS, 0.0
    if tag in BOILER_TAGS:
        boiler = HARD
    elif tag == "header":
        # a page's header; within the article it holds the heading, which is content
        boiler = 1.5 if up.main else HARD
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                if value.lower() in BOILER_ROLES:
                    boiler = HARD
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                boiler = HARD
            elif name in ("class", "id"):
                words = {w.lower() for w in _SPLIT.split(value) if w}
                if words & BOILER_WORDS and tag not in ("body", "html") and (not words & MAIN_WORDS or tag not in MAIN_TAGS or words & {"comment", "comments"}):
                    loose = max(loose, LOOSE if words <= BOILER_WORDS | GENERIC_WORDS else FAINT)
                if words & HEADER_WORDS and not words & MAIN_WORDS and not up.main and tag not in HEADING_TAGS and tag not in ("body", "html"):
                    loose = LOOSE
                elif tag in ("div", "section", "td") and words & MAIN_WORDS and not boiler and not loose:
                    main = True
    return boiler, main, loose


_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table td th div section article main body html aside nav footer header form blockquote".split())


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: runs of text between block-level tags, references decoded, white space single."""
    root = _Node("", None, False, 0.0, False, False, 0)
    here, out, parts, linked, count = root, [], [], 0, 0
    owner = root
    raw: str | None = None

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, owner))
            parts.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if not here.skip:
                text = _html.unescape(text) if "&" in text else text
                if not parts:
                    owner = here
                parts.append(text)
                if here.in_link:
                    linked += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in BLOCK_TAGS:
                close()
            n = here
            while n is not root and n.tag != tag:
                n = n.up
            if n is not root:
                here = n.up
            continue
        if tag in BLOCK_TAGS or tag in SKIPPED_TAGS and tag not in ("svg", "annotation", "annotation-xml"):
            close()
        if tag in VOID_TAGS:
            if tag == "br" and parts:
                parts.append(" ")
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if here.skip and tag not in HEAD_TAGS:
            # what can't stand in a head ends it, whether its end tag is there or not
            n = here
            while n is not root and n.tag != "head":
                n = n.up
            if n is not root:
                here = n.up
        if tag in BLOCK_TAGS:
            # a block ends an open paragraph; items, cells and rows end their like
            shut = _CLOSES.get(tag, {"p"})
            n = here
            while n is not root:
                if n.tag in shut:
                    here = n.up
                    if tag != "tr":
                        break
                elif n.tag in _SCOPES and not (tag == "tr" and n.tag in ("td", "th")):
                    break
                n = n.up
        if attrs.endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        boiler, main, loose = _judge(tag, attrs, here)
        if main:
            n = here
            while n is not None and not n.holds:
                n.holds = True
                n = n.up
        count += 1
        here = _Node(tag, here, here.skip or tag in SKIPPED_TAGS, max(here.boiler, boiler), here.main or main, here.in_link or tag == "a", count, loose)
        if tag in RAW_TAGS:
            raw = tag
            stop = re.compile(rf"</{raw}\s*/?>", re.I).search(page, at)
            inner_end = stop.start() if stop else end
            at = stop.end() if stop else end
            here = here.up
            del inner_end
    close()
    return out


def _container(n: _Node) -> _Node:
    while n.up is not None and n.tag not in BLOCK_TAGS:
        n = n.up
    return n


def _loose(found: list[Block]) -> dict[int, float]:
    """Costs of the elements whose class or id words count: those that hold neither a main element nor half of the page's unlinked text."""
    held: dict[int, int] = {}
    total, named = 0, {}
    for b in found:
        if b.node.boiler >= HARD:
            continue
        own = max(0, len(b.text) - b.linked)
        total += own
        n = b.node
        while n is not None:
            if n.loose:
                named[n.key] = n
                held[n.key] = held.get(n.key, 0) + own
            n = n.up
    return {k: n.loose for k, n in named.items() if not n.holds and 2 * held[k] < total}


def _loose_cost(n: _Node | None, counted: dict[int, float]) -> float:
    most = 0.0
    while n is not None:
        most = max(most, counted.get(n.key, 0.0))
        n = n.up
    return most


def signs(b: Block) -> list[float]:
    """``FEATURES`` of a block by itself, wherever it stands."""
    tag = _container(b.node).tag
    return [
        math.log(b.text.count(" ") + 2), min(1.0, b.linked / max(1, len(b.text))), float(b.text[-1] in ".!?。…\"”»"), float(tag == "p"), float(tag in HEADING_TAGS),
        float(tag in ("li", "dt", "dd")), float(tag in ("td", "th")), float("©" in b.text or "rights reserved" in b.text.lower()),
    ]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic weights (the constant last), drawn toward ``PRIOR``; classes weigh alike. Newton's method."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    d = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        step = np.linalg.solve((d * (w * p * (1 - p))[:, None]).T @ d + PRIOR_WEIGHT * np.eye(len(beta)), d.T @ (w * (p - y)) + PRIOR_WEIGHT * (beta - PRIOR))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def told(found: list[Block]) -> list[tuple[list[float], float]]:
    """Features and labels of the blocks that a page's own elements tell apart: content of a main element, or of one that holds none by definition."""
    counted = _loose(found)
    out = []
    for b in found:
        if b.node.boiler >= HARD:
            out.append((signs(b), 0.0))
        elif b.node.main and not (counted and _loose_cost(b.node, counted)):
            out.append((signs(b), 1.0))
    step = -(-len(out) // FIT_BLOCKS) or 1
    return out[::step]


def costs(found: list[Block], weights: np.ndarray = PRIOR) -> list[float]:
    """What calling each block boilerplate costs more than calling it content, in log odds: the classifier's, and its containers'."""
    has_main = any(b.node.main and b.node.boiler < HARD for b in found)
    counted = _loose(found)
    own, constant = weights[:-1].tolist(), float(weights[-1])
    out = []
    for b in found:
        boiler = b.node.boiler
        if boiler >= HARD:
            out.append(-boiler)
            continue
        e = constant + sum(w * x for w, x in zip(own, signs(b), strict=True))
        if has_main:
            e += INSIDE if b.node.main else -OUTSIDE
        if boiler and _container(b.node).tag not in HEADING_TAGS:
            e -= boiler
        if counted:
            e -= _loose_cost(b.node, counted)
        out.append(e)
    return out


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in page order, and the block before in the same container's parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        box = _container(b.node)
        parent = box.up.key if box.up is not None else 0
        if i:
            prev = found[i - 1]
            same = (prev.node.boiler >= HARD) == (b.node.boiler >= HARD) and prev.node.main == b.node.main
            out.append((i - 1, i, ADJACENT if same else ACROSS))
        j = last.get(parent)
        if j is not None and j != i - 1:
            out.append((j, i, SIBLING))
        last[parent] = i
    return out


def min_cut(e: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    Terminal capacities are |e| to the source (e > 0) or the sink. A node whose terminal
    outweighs all its links takes its own side in every minimum cut; such nodes are
    settled first and pass their links on as terminals. What is left goes to max-flow.
    """
    n = len(e)
    e = list(e)
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        if i != j and w > 0:
            adj[i][j] = adj[i].get(j, 0.0) + w
            adj[j][i] = adj[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(e[i]) > sum(adj[i].values()):
            side[i] = e[i] > 0
            for j, w in adj[i].items():
                e[j] += w if side[i] else -w
                del adj[j][i]
                if side[j] is None:
                    queue.append(j)
            adj[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        reached = _max_flow(left, e, adj)
        for i in left:
            side[i] = i in reached
    return [bool(x) for x in side]


def _max_flow(nodes: list[int], e: list[float], adj: list[dict[int, float]]) -> set[int]:
    """Nodes still reachable from the source when no augmenting path is left (shortest paths first)."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(adj[i]) for i in nodes}
    cap[s], cap[t] = {}, {}
    for i in nodes:
        if e[i] > 0:
            cap[s][i] = e[i]
            cap[i][s] = 0.0
        elif e[i] < 0:
            cap[i][t] = -e[i]
            cap[t][i] = 0.0
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return set(level) - {s}
        rest = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                    if cut is None and cap[a][b] <= 1e-12:
                        cut = k
                path = path[: (cut or 0) + 1]
                continue
            for v in rest[u]:
                if cap[u].get(v, 0.0) > 1e-12 and level.get(v, -1) == level[u] + 1:
                    path.append(v)
                    # the arc may carry more: look at it again after this path
                    rest[u] = _chain_first(v, rest[u])
                    break
            else:
                path.pop()
                if path:
                    level[u] = -1


def _chain_first(v: int, it: Iterator[int]) -> Iterator[int]:
    yield v
    yield from it


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The page's article as one line: content blocks in page order, joined by a space."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = min_cut(costs(found, weights), edges(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def fit_on(pages: DataFrame, html: str = "html", most: int = FIT_PAGES) -> np.ndarray:
    """Weights of the block classifier from at most ``most`` different pages, those of the smallest hashes, labelled by their own elements."""
    p = pages.select(F.xxhash64(html).alias("h"), F.col(html).alias("html")).where(F.col("html").isNotNull())
    last = p.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return PRIOR

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for page in b["html"] for r in told(blocks(page))]
            yield pd.DataFrame({"x": [r[0] for r in rows], "y": [r[1] for r in rows]})

    got = p.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("html").alias("html")).select("html").mapInPandas(run, "x array<double>, y double").toPandas()  # most * FIT_BLOCKS rows
    order = np.lexsort(np.array(got["x"].tolist()).T) if len(got) else []
    return fit(np.array(got["x"].tolist()).reshape(-1, len(FEATURES))[order], got["y"].to_numpy(dtype=float)[order])


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: a map over pages, no shuffle of them.

    A page's text blocks are nodes between content and boilerplate. What it costs to label a
    block against its evidence are log odds: of a classifier fitted on blocks of a bounded
    sample of the pages, and of the containers the block stands in. Labels that differ
    between neighbours cost too, and a minimum cut finds the cheapest labels of all.

    Null, empty or textless html: text "" and 0. Repeated rows come out as often. A page
    is handled whole whatever its length. Extra columns are not read.
    """
    weights = fit_on(pages, html)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, weights) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    p = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = dict(p.dtypes)
    return p.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
