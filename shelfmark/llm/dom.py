"""A small HTML tree builder: flat arrays of elements and runs of text, in document order."""

from __future__ import annotations

import html as _html
import re
from collections import Counter

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements whose text is never shown as running text.
UNSEEN = frozenset("head script style title noscript iframe template svg select option button textarea xmp noembed noframes object datalist canvas".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option legend".split())
#: An opening tag ends an open element of these, up to one of those.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)


class Tree:
    """Elements in document order: ``tag, attrs`` (source text), ``parent`` (index, -1 at the top);
    text runs as ``(element, block number, text)`` with character references decoded."""

    __slots__ = ("attrs", "parent", "runs", "tag")

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.attrs: list[str] = []
        self.parent: list[int] = []
        self.runs: list[tuple[int, int, str]] = []


def parse(source: str) -> Tree:
    t, stack, opened, block, at, unseen = Tree(), [], Counter(), 0, 0, 0

    def pop_to(depth: int) -> None:
        nonlocal unseen
        while len(stack) > depth:
            name = t.tag[stack.pop()]
            opened[name] -= 1
            unseen -= name in UNSEEN

    def find(names, stops) -> int:
        for k in range(len(stack) - 1, -1, -1):
            name = t.tag[stack[k]]
            if name in names:
                return k
            if name in stops:
                return -1
        return -1

    def add_text(text: str) -> None:
        if text and not unseen:
            t.runs.append((stack[-1] if stack else -1, block, _html.unescape(text) if "&" in text else text))

    end = len(source)
    while at < end:
        m = TAG.search(source, at)
        if not m:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if opened[name] <= 0:
                block += name in BLOCK
                continue
            k = find((name,), () if name in BLOCK or name in UNSEEN else BLOCK)
            if k >= 0:
                pop_to(k)
            block += name in BLOCK
            continue
        if name == "br" and not unseen:
            t.runs.append((stack[-1] if stack else -1, block, " "))
        if name in CLOSES_P and opened["p"] > 0:
            k = find(("p",), ("button", "td", "th", "table", "caption", "object"))
            if k >= 0:
                pop_to(k)
        elif name == "body" and opened["head"] > 0:
            pop_to(find(("head",), ()))
        if name in IMPLIED:
            names, stops = IMPLIED[name]
            if any(opened[x] > 0 for x in names):
                k = find(names, stops)
                if k >= 0:
                    pop_to(k)
        block += name in BLOCK
        if name in VOID:
            continue
        t.tag.append(name)
        t.attrs.append(m[3])
        t.parent.append(stack[-1] if stack else -1)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            inner = source[at : close.start()] if close else source[at:]
            at = close.end() if close else end
            if name not in UNSEEN:
                t.runs.append((len(t.tag) - 1, block, inner))
            continue
        if m[0].endswith("/>") and name in ("svg", "path", "circle"):
            continue
        stack.append(len(t.tag) - 1)
        opened[name] += 1
        unseen += name in UNSEEN
    return t


def attributes(source: str) -> dict[str, str]:
    """Attribute names (lower-case) and values of an opening tag; the first of equal names counts."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(source):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out
