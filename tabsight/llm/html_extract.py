"""Main text of web pages by minimum-cut labelling.

A page is read into blocks (runs of text that no block element divides) and the containers around them.
Each block and container is a node of a flow network.  A classifier's log-odds that a block is content
becomes its capacity from the source (content) or to the sink (boilerplate); containers get capacities
from what their tag, class, id and role say.  Blocks that follow each other, blocks and their
container, and containers and their parents are joined by smoothness edges.  The minimum cut, found
by maximum flow, leaves on the source side what is content.

The classifier is a logistic regression, trained here on blocks whose containers leave no doubt; during
training that evidence is hidden from one copy of each, and the tags too from another, so that text
alone has to tell as well.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 500

# fixed values: element names of HTML
RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("template noscript iframe svg select button canvas audio video datalist".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr br input meta link object param "
                   # formulas
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup "
                   "munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th figcaption caption summary address".split())

#: What a tag or a word of class, id or role says of a container.
AGAINST_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
AGAINST_WORDS = frozenset(
    "nav navbar navigation menu header masthead topbar footer bottombar sidebar aside rail ad ads adv advert advertisement "
    "advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert "
    "newsletter subscribe subscription signup login form search comment comments commentlist disqus respond reply replies "
    "discussion related recommended share sharing social breadcrumb breadcrumbs pagination pager widget popup modal overlay "
    "toolbar copyright legal disclaimer contentinfo complementary dialog teaser outbrain taboola".split())
FOR_TAGS = frozenset(("article", "main"))
FOR_WORDS = frozenset("article main content post entry story articlebody maincontent".split())

#: Words that name any part of a page: beside a word against it they say nothing for it (``widget-content``).
ANY_PART = frozenset("main content post entry".split())
#: A class with one of these tells of something else (``has-sidebar``, ``ad-free``).
NOT_ITSELF = frozenset("has with no without free".split())

SURE, WORD = 1_000_000, 2_500         # capacities, in thousandths of a unit of log-odds
HOLD, KIN, NEXT, APART = 6_000, 2_000, 1_000, 300
CLIP = 4.0
#: What is looked at in vain for the ends of quotes, in lengths of the page; beyond it tags end at the next ``>``.
VAIN = 64

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>""")
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in (*RAW, "head")}
_ATTR = re.compile(r"""\b(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Container(NamedTuple):
    parent: int
    says: int        # 2 surely content, 1 likely, 0 nothing, -1 likely boilerplate, -2 surely
    words: int       # words of class, id and role for content less those against it


class Block(NamedTuple):
    text: str
    container: int
    tag: str
    linked: int      # characters in links


def _hidden(attrs: str) -> bool:
    return any(name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(v), re.I)
               for name, *v in _ATTR.findall(attrs))


def _word_evidence(attrs: str) -> int:
    """Names in class, id and role that are for content, less those against it."""
    names = {x for name, *v in _ATTR.findall(attrs) if name.lower() in ("class", "id", "role") for x in "".join(v).split()}
    words = [{w.lower() for w in _WORD.findall(name)} | {name.lower()} for name in names]
    words = [w for w in words if not w & NOT_ITSELF]
    against = sum(bool(w & AGAINST_WORDS) for w in words)
    return sum(bool(w & FOR_WORDS - (ANY_PART if against else set())) for w in words) - against


def _says(tag: str, attrs: str, inside_article: bool) -> tuple[int, int]:
    """What a container's tag and attributes say, and the evidence of its words: only tags and hiding are sure."""
    if tag in AGAINST_TAGS or tag == "header" and not inside_article or attrs and _hidden(attrs):
        return -2, 0
    words = _word_evidence(attrs) if attrs else 0
    if tag in FOR_TAGS:
        return 2, 0
    if words < 0 and (tag in ("body", "html") or tag == "header"):
        words = 0
    return (words > 0) - (words < 0), words


class Tag(NamedTuple):
    start: int
    end: int
    close: bool
    name: str        # empty: a part of the page that is not shown
    attrs: str


def tags(page: str) -> list[Tag]:
    """Tags in page order, in time linear in the page whatever is left open in it.

    Comments, raw text, declarations and a closed head are single unnamed parts.  A tag ends at the first ``>``
    outside of quotes, or at the first one if its quotes do not close.
    """
    out: list[Tag] = []
    last, vain, headless = page.rfind(">"), VAIN * len(page), False
    at = page.find("<")
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            out.append(Tag(at, end, False, "", ""))
        elif at > last:
            at = page.find("<!--", at)     # nothing but an open comment can begin here
            continue
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            out.append(Tag(at, end, False, "", ""))
        elif m := _NAME.match(page, at):
            rest = _REST.match(page, m.end()) if vain > 0 else None
            if not rest:
                vain -= len(page) - at
            end = rest.end() if rest else page.find(">", m.end()) + 1
            name, attrs = m[2].lower(), page[m.end():end - 1]
            raw = not m[1] and name in RAW and not attrs.endswith("/")
            if raw or not m[1] and name == "head" and not headless:
                closed = _CLOSE[name].search(page, end)
                headless = not raw and closed is None
                if closed or raw:
                    end, name = closed.end() if closed else len(page), ""
            out.append(Tag(at, end, bool(m[1]), name, attrs))
        at = page.find("<", max(end, at + 1))
    return out


def _shown(page: str) -> list[Tag]:
    """The tags of a page, with skipped elements as single unnamed parts; of one that is not closed only the tag is skipped."""
    found = tags(page)
    opened: dict[str, list[int]] = {}
    spans = []
    for t in found:
        if t.name in SKIPPED:
            same = opened.setdefault(t.name, [])
            spans.append((same.pop() if t.close and same else t.start, t.end))
            if not t.close and not t.attrs.endswith("/"):
                same.append(t.start)
    if not spans:
        return found
    parts: list[Tag] = []
    for start, end in sorted(spans):
        if not parts or end > parts[-1].end:
            parts.append(Tag(max(start, parts[-1].end) if parts else start, end, False, "", ""))
    out, i = [], 0
    for t in found:
        while i < len(parts) and parts[i].start <= t.start:
            out.append(parts[i])
            i += 1
        if not out or t.start >= out[-1].end:
            out.append(t)
    return out


def parse(page: str | None) -> tuple[list[Block], list[Container]]:
    """Blocks in page order and containers (the first is the page); nothing for a null or empty page."""
    text = page or ""
    blocks: list[Block] = []
    containers = [Container(-1, 0, 0)]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]   # tag, container, inside an article
    opened: dict[str, int] = {}                             # tags on the stack
    run: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            joined = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if joined:
                blocks.append(Block(joined, stack[-1][1], stack[-1][0], min(linked, len(joined))))
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    at = 0
    for t in _shown(text):
        if t.start > at:
            piece = text[at:t.start]
            run.append(piece)
            if links:
                linked += len(piece.strip())
        at, tag = t.end, t.name
        if not tag:
            run.append(" ")
            continue
        if t.close:
            if tag == "a":
                links = max(0, links - 1)
            if opened.get(tag):
                flush()
                while pop() != tag:
                    pass
            elif tag not in INLINE:
                flush()
            continue
        if tag in INLINE and (tag in VOID or not t.attrs or not _hidden(t.attrs)):   # no class takes a word out of its sentence
            links += tag == "a"
            if tag in ("br", "img", "wbr"):
                run.append(" " if tag != "wbr" else "")
            continue
        flush()
        if tag in VOID:
            continue
        said, words = _says(tag, t.attrs, stack[-1][2])
        links = links if tag == "a" else 0
        while stack[-1][0] == "p" and tag not in INLINE or tag == stack[-1][0] and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            pop()
        if tag in LEAF and not said:
            container = stack[-1][1]
        else:
            containers.append(Container(stack[-1][1], said, words))
            container = len(containers) - 1
        stack.append((tag, container, stack[-1][2] or tag == "article"))
        opened[tag] = opened.get(tag, 0) + 1
    run.append(text[at:])
    flush()
    return blocks, containers


FEATURES = 11


def features(blocks: list[Block], containers: list[Container]) -> tuple[np.ndarray, np.ndarray]:
    """One row per block, and what its nearest telling container says of it."""
    says = np.zeros(len(containers), int)
    for i, c in enumerate(containers):
        says[i] = c.says or (says[c.parent] if c.parent >= 0 else 0)
    central = any(c.says == 2 for c in containers)
    x, told = np.zeros((len(blocks), FEATURES)), np.zeros(len(blocks), int)
    for i, b in enumerate(blocks):
        told[i] = says[b.container]
        n, w = len(b.text), b.text.count(" ") + 1
        x[i] = (1, np.log1p(w), b.linked / n, b.text[-1] in ".!?:;\"'»”…", b.tag == "p", b.tag == "li", b.tag[:1] == "h" and b.tag[1:].isdigit(),
                min(1, 10 * sum(map(b.text.count, ",.")) / n), told[i] > 0, told[i] < 0, central and told[i] <= 0)
    return x, told


PRIOR = np.array([-1.5, 0.6, -4.0, 0.5, 0.5, -0.5, 0.2, 0.5, 2.0, -3.0, -3.0])


def train(x: np.ndarray, told: np.ndarray, pull: float = 1.0, steps: int = 300) -> np.ndarray:
    """Weights by gradient descent from ``PRIOR``, to which ``pull`` holds them; no telling block leaves them there."""
    sure = (told == 2) | (told < 0)
    if not sure.any():
        return PRIOR.copy()
    blind, plain = x[sure].copy(), x[sure].copy()
    blind[:, 8:] = 0
    plain[:, 4:] = 0
    xs, y = np.vstack([x[sure], blind, plain]), np.tile((told[sure] > 0).astype(float), 3)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        w -= 0.5 * (xs.T @ (weight * (p - y)) + pull * 1e-3 * (w - PRIOR))
    return w


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut (the largest such side); edges carry both ways.

    Blocking flows over levels from the sink (Dinic), with capacities as whole numbers.
    """
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]   # what crosses a node at once needs no path
    head: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, c in edges:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to += [b, a]
        cap += [c, c]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] < 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            v = queue.popleft()
            if excess[v] > 0:
                reached = True
                continue
            for e in head[v]:
                u = to[e]
                if level[u] < 0 and cap[e ^ 1] > 0:
                    level[u] = level[v] + 1
                    queue.append(u)
        if not reached:
            return [x < 0 for x in level]
        after = [0] * n
        for s in range(n):
            while excess[s] > 0 and level[s] > 0:
                path, v = [], s
                while excess[v] >= 0 or v == s:
                    while after[v] < len(head[v]):
                        e = head[v][after[v]]
                        if cap[e] > 0 and level[to[e]] == level[v] - 1 and level[to[e]] >= 0:
                            break
                        after[v] += 1
                    if after[v] < len(head[v]):
                        path.append(head[v][after[v]])
                        v = to[path[-1]]
                        if level[v] == 0:
                            if excess[v] < 0:
                                break
                            v = to[path.pop() ^ 1]   # a sink that is full
                            after[v] += 1
                    elif path:
                        v = to[path.pop() ^ 1]
                        after[v] += 1
                    else:
                        break
                if not path:
                    break
                flow = min(excess[s], -excess[v], *(cap[e] for e in path))
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                excess[s] -= flow
                excess[v] += flow


def extract(page: str | None, weights: np.ndarray) -> str:
    """Content blocks of a page, in page order, joined by one line feed; empty if there are none."""
    blocks, containers = parse(page)
    if not blocks:
        return ""
    x, _ = features(blocks, containers)
    odds = (1000 * np.clip(x @ weights, -CLIP, CLIP)).astype(int).tolist()
    n = len(blocks)
    source = [max(0, o) for o in odds] + [SURE if c.says == 2 else WORD * max(0, c.words) for c in containers]
    sink = [max(0, -o) for o in odds] + [SURE if c.says == -2 else WORD * max(0, -c.words) for c in containers]
    edges = [(i, n + b.container, HOLD) for i, b in enumerate(blocks)]
    edges += [(n + i, n + c.parent, KIN) for i, c in enumerate(containers) if c.parent >= 0]
    edges += [(i, i + 1, NEXT if blocks[i].container == blocks[i + 1].container else APART) for i in range(n - 1)]
    side = minimum_cut(source, sink, edges)
    return "\n".join(b.text for b, content in zip(blocks, side, strict=False) if content)


def learn(df: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Classifier weights from the blocks of at most ``train_pages`` pages: the first ids by their hash, of an id the least page."""
    ids = df.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(train_pages)
    picked = (df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("html is not null")
              .join(F.broadcast(ids), "id").groupBy("id").agg(F.min("html").alias("html")))   # an id may repeat: one page each

    @F.pandas_udf("array<array<double>>")
    def rows(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            x, told = features(*parse(page))
            kept = {tuple(r) for r in np.round(np.column_stack([told, x]), 3)}   # distinct blocks of a page
            out.append([list(r) for r in sorted(kept)])
        return pd.Series(out)

    found = [r for p in picked.select(rows("html").alias("r")).collect() for r in p["r"]]
    if not found:
        return PRIOR.copy()
    z = np.array(found)
    return train(z[:, 1:], z[:, 0].astype(int))


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``df`` with a column ``text`` (replacing one of that name): the main text, empty if there is none.

    A null or empty page has an empty text.  Every row is read whole and on its own, so repeated ids and
    rows do not matter; an empty table gives no rows.
    """
    weights = learn(df, id_col, html_col, train_pages)

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, weights) for p in pages])

    return df.withColumn("text", text(F.col(html_col)))
