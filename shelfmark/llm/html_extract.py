"""Main-text extraction: gradient-boosted trees over features of DOM nodes, decoded top down.

Nodes are block elements and any element with a class, id or role. Their features are the density of
the subtree (text, links, punctuation, tags), attribute tokens, depth, place among siblings and what
their ancestors are. The trees are fitted on generated pages whose nodes are labelled by construction
(a fixed seed and number of pages; nothing of the input is used). Decoding chooses for the whole tree
at once, by the sum of log-likelihoods, which nodes to keep, such that nothing below a dropped node
is kept.
"""

from __future__ import annotations

import math
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .dom import BLOCK, Tree, attributes, parse

# Tags and attribute tokens that the features look for.
TAGS = "article main section div p h1 h2 h3 ul ol li table td nav header footer aside form blockquote pre figure figcaption span a body dl".split()
WORDS = {
    "main": "article articles content main post entry story body text prose hentry maincontent articlebody page blog read",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs crumbs skip links submenu",
    "header": "header masthead banner branding topbar logo top site head",
    "footer": "footer foot copyright bottom colophon legal credits imprint",
    "side": "sidebar side aside widget widgets related recommended popular trending more rail secondary complementary teaser also",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion adsense dfp outbrain taboola partner",
    "notice": "cookie cookies consent notice alert gdpr privacy popup modal newsletter subscribe paywall overlay disclaimer warning message signup toast",
    "comment": "comment comments reply replies discussion disqus respond responses commentlist thread",
    "form": "form search login signin register input contact subscribe",
    "share": "share sharing social tags tag meta byline author date timestamp tools actions",
    "hidden": "hidden invisible none sr offscreen",
}
GROUPS = {k: frozenset(v.split()) for k, v in WORDS.items()}
OPEN_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "li", "table")
#: Blocks of running text.
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table figure div section".split())
#: Characters of its own from which a node without many links counts as prose.
PROSE = 80
RAISES = (1, 2, 3, 4)
CUT = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
STOPS = re.compile(r"[.,;:!?]")


class Nodes:
    """Features of the nodes of one page, and which node each text run belongs to."""

    __slots__ = ("features", "marks", "owner", "parent", "prose", "tree")

    def __init__(self, source: str) -> None:
        tree: Tree = parse(source)
        n_el = len(tree.tag)
        unit, parent, tags, attrs = [0] * n_el, [-1], ["#root"], [{}]
        for i in range(n_el):
            up = unit[tree.parent[i]] if tree.parent[i] >= 0 else 0
            a = attributes(tree.attrs[i]) if tree.attrs[i].strip(" /\n\t") else {}
            if tree.tag[i] in BLOCK or "class" in a or "id" in a or "role" in a or "itemprop" in a:
                unit[i] = len(parent)
                parent.append(up)
                tags.append(tree.tag[i])
                attrs.append(a)
            else:
                unit[i] = up
        in_link = [False] * n_el
        for i in range(n_el):
            in_link[i] = tree.tag[i] == "a" or (tree.parent[i] >= 0 and in_link[tree.parent[i]])
        n = len(parent)
        # chars, words, stops, chars in links, links, elements, own chars, capitals
        s = np.zeros((n, 8))
        self.owner = [unit[e] if e >= 0 else 0 for e, _, _ in tree.runs]
        for (e, _, text), u in zip(tree.runs, self.owner, strict=True):
            c = len(text) - text.count(" ")
            s[u, 0] += c
            s[u, 1] += len(text.split())
            s[u, 2] += len(STOPS.findall(text))
            s[u, 6] += c
            if e >= 0 and in_link[e]:
                s[u, 3] += c
        for i in range(n_el):
            s[unit[i], 4] += tree.tag[i] == "a"
            s[unit[i], 5] += 1
        for u in range(n - 1, 0, -1):
            s[parent[u], :6] += s[u, :6]
        self.tree, self.parent = tree, parent
        self.marks = [a.get("data-y") for a in attrs]
        named = np.array([t in ("article", "main") for t in tags])
        self.prose = bool((((s[:, 6] >= PROSE) & (s[:, 3] < 0.3 * s[:, 0])) | (named & (s[:, 0] > 0))).any())
        self.features = self._features(parent, tags, attrs, s)

    @staticmethod
    def _features(parent, tags, attrs, s) -> np.ndarray:
        n, total = len(parent), max(1.0, s[0, 0])
        kids: list[list[int]] = [[] for _ in range(n)]
        for u in range(1, n):
            kids[parent[u]].append(u)
        seen = np.zeros((n, len(OPEN_TAGS) + len(GROUPS)), dtype=np.float64)
        own = np.zeros((n, len(GROUPS)))
        depth = np.zeros(n)
        before = np.zeros(n)
        place = np.zeros((n, 4))
        for u in range(1, n):
            p, a = parent[u], attrs[u]
            depth[u] = depth[p] + 1
            if a:
                names = " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
                tokens = set(CUT.findall(CAMEL.sub(r"\1 \2", names).lower()))
                if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
                    tokens.add("hidden")
                own[u] = [bool(tokens & g) for g in GROUPS.values()]
            seen[u] = seen[p]
            if p:
                seen[u, len(OPEN_TAGS) :] = np.maximum(seen[u, len(OPEN_TAGS) :], own[p])
                if tags[p] in OPEN_TAGS:
                    seen[u, OPEN_TAGS.index(tags[p])] = 1
        for p in range(n):
            at = before[p]
            same: dict[str, int] = {}
            for k in kids[p]:
                same[tags[k]] = same.get(tags[k], 0) + 1
            for i, k in enumerate(kids[p]):
                place[k] = (i / len(kids[p]), math.log1p(len(kids[p])), same[tags[k]] / len(kids[p]), s[k, 0] / max(1.0, s[p, 0]))
                before[k] = at
                at += s[k, 0]
        chars, words, stops, linked, links, elements, direct, _ = s.T
        one = np.maximum(chars, 1)
        # What stands beside a node: its neighbours, and all siblings with running text.
        heading = np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tags])
        textual = np.array([t in TEXTUAL for t in tags]) & (linked < 0.5 * one) & (chars > 0)
        beside = np.zeros((n, 9))
        for p in range(n):
            row = kids[p]
            if not row:
                continue
            text = np.where(textual[row], chars[row], 0.0)
            every, share = text.sum(), max(1.0, s[p, 0])
            for i, k in enumerate(row):
                before_, after = row[i - 1] if i else 0, row[i + 1] if i + 1 < len(row) else 0
                beside[k] = (
                    math.log1p(chars[before_]) if before_ else -1,
                    math.log1p(chars[after]) if after else -1,
                    bool(before_) and textual[before_],
                    bool(after) and textual[after],
                    bool(after) and heading[after],
                    bool(before_) and heading[before_],
                    math.log1p(every - text[i]),
                    (every - text[i]) / share,
                    len(row),
                )
        columns = [
            depth,
            np.log1p(chars),
            np.log1p(words),
            np.log1p(direct),
            direct / one,
            linked / one,
            links / np.maximum(words, 1),
            elements / one,
            stops / np.maximum(words, 1),
            chars / np.maximum(words, 1),
            chars / total,
            before / total,
            (before + chars) / total,
            np.array([len(k) for k in kids], dtype=np.float64),
        ]
        which = np.array([[t == x for x in TAGS] for t in tags], dtype=np.float64)
        return np.concatenate([np.stack(columns, axis=1), place, beside, which, own, seen], axis=1)


def decode(parent: list[int], p: np.ndarray, start: int, weight: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes ``start .. start + len(parent)`` such that nothing below a dropped
    node is kept. Parents come before their children; node 0 is the page itself and always open."""
    n = len(parent)
    q = np.clip(p[start : start + n], 1e-6, 1 - 1e-6)
    keep, drop = (np.log(q) * weight).tolist(), (np.log1p(-q) * weight).tolist()
    for u in range(n - 1, 0, -1):
        keep[parent[u]] += max(keep[u], drop[u])
        drop[parent[u]] += drop[u]
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    for u in range(1, n):
        kept[u] = kept[parent[u]] and keep[u] >= drop[u]
    return kept


def text_of(nodes: Nodes, kept: np.ndarray) -> str:
    """The text of the kept nodes: white space in a block becomes one space, blocks get a line each."""
    blocks: list[str] = []
    last, parts = None, []
    for (_, block, text), u in zip(nodes.tree.runs, nodes.owner, strict=True):
        if block != last:
            blocks.append("".join(parts))
            last, parts = block, []
        if kept[u]:
            parts.append(text)
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(sources: list[str | None], model: Trees) -> list[str]:
    pages = [Nodes(s or "") for s in sources]
    if not pages:
        return []
    p = model.probability(np.concatenate([x.features for x in pages]))
    out, at = [], 0
    for x in pages:
        n = len(x.parent)
        own = np.clip(p[at : at + n], 1e-6, 1 - 1e-6)
        kept = decode(x.parent, own, 0, np.ones(n))
        # A page with prose or an article that has nothing likely: the odds are raised until some of it is kept.
        if not kept[1:].any() and x.prose:
            for raise_ in RAISES:
                odds = own / (1 - own) * math.exp(raise_)
                kept = decode(x.parent, odds / (1 + odds), 0, np.ones(n))
                if kept[1:].any():
                    break
        out.append(text_of(x, kept))
        at += n
    return out


def train(pages: int = 900, seed: int = 7) -> Trees:
    """Fits on generated pages; each node is labelled by what most of its text is. Kept per process."""
    cache = sys.modules.setdefault("_shelfmark_dom_models", types.ModuleType("_shelfmark_dom_models")).__dict__
    if (pages, seed) in cache:
        return cache[pages, seed]
    from .sample_pages import sample_page

    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = Nodes(sample_page(rng))
        n = len(nodes.parent)
        state = [0] * n
        for u in range(1, n):
            state[u] = int(nodes.marks[u]) if nodes.marks[u] is not None else state[nodes.parent[u]]
        good, every = np.zeros(n), np.zeros(n)
        for (_, _, text), u in zip(nodes.tree.runs, nodes.owner, strict=True):
            good[u] += state[u] * len(text.split())
            every[u] += len(text.split())
        for u in range(n - 1, 0, -1):
            good[nodes.parent[u]] += good[u]
            every[nodes.parent[u]] += every[u]
        use = every > 0
        use[0] = False
        xs.append(nodes.features[use])
        ys.append((good[use] > 0.5 * every[use]).astype(np.float64))
    cache[pages, seed] = fit(np.concatenate(xs), np.concatenate(ys), trees=60, depth=5, rate=0.2, bins=16)
    return cache[pages, seed]


def main_text(df: DataFrame, html: str = "html", out: str = "text", model: Trees | None = None, batch: int = 64) -> DataFrame:
    """Adds ``out``, the main text of each page (a column of that name is replaced).

    Null and empty pages, and pages without main text, give an empty text. Malformed pages are read
    as far as they go, whole pages at any length. Rows are kept as they are, repeats too.
    """
    trees = model or train()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            values = b.tolist()
            yield pd.Series([t for i in range(0, len(values), batch) for t in extract(values[i : i + batch], trees)], dtype=object)

    return df.withColumn(out, run(F.col(html)))
