"""Generated web pages with labelled nodes, to train the extractor on. ``data-y`` marks a subtree."""

from __future__ import annotations

import numpy as np

SYLLABLES = "ba ko ri ten mu sal dor vi lan e par to ne sti ga hu ol mer qui zan pel fo".split()
MAIN_NAMES = ["content", "article-body", "post", "entry-content", "story", "main-content", "page-content", "post-body", "text", "blog-post"]
JUNK = {
    "nav": ["menu", "main-nav", "navbar", "breadcrumb", "site-navigation", "toc", "pagination", "nav-links"],
    "header": ["header", "site-header", "masthead", "topbar", "branding"],
    "footer": ["footer", "site-footer", "bottom", "copyright"],
    "side": ["sidebar", "widget", "related-posts", "side", "popular", "more-stories", "recommended", "right-rail"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot", "advertisement"],
    "notice": ["cookie-notice", "consent-banner", "alert", "newsletter-signup", "notice", "paywall-message", "gdpr", "popup"],
    "comments": ["comments", "comment-list", "discussion", "responses", "disqus-thread", "replies"],
    "share": ["share", "social-links", "post-meta", "tags", "byline"],
}


class _Page:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.named = rng.random() < 0.8  # else a page without telling names
        self.semantic = rng.random() < 0.75  # else only div and span

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def words(self, lo: int, hi: int) -> str:
        r, out = self.rng, []
        for i in range(int(r.integers(lo, hi + 1))):
            w = "".join(SYLLABLES[k] for k in r.integers(0, len(SYLLABLES), r.integers(1, 4)))
            out.append(w.capitalize() if i == 0 or r.random() < 0.04 else w)
            if r.random() < 0.1:
                out[-1] += self.pick([",", ".", ";", "."])
        return " ".join(out)

    def prose(self, lo: int = 8, hi: int = 90) -> str:
        s = self.words(lo, hi)
        if self.chance(0.15):
            s = f"<b>{s}</b>" if self.chance(0.5) else f"<b>{s}"
        if self.chance(0.2):
            s += f' <a href="/{self.words(1, 1)}">{self.words(1, 4)}</a> {self.words(1, 12)}'
        if self.chance(0.1):
            s += " &amp; " + self.pick(["%%%", "***", "$$$", "###"]) + " " + self.words(1, 6)
        return s + self.pick([".", ".", "", "!", "?"])

    def attr(self, names: list[str] | None, p: float = 0.85) -> str:
        if names and self.named and self.chance(p):
            return f' {self.pick(["class", "class", "id"])}="{self.pick(names)}"'
        return f' class="{self.pick(["row", "col", "box", "wrap", "inner", "x1", "block"])}"' if self.chance(0.25) else ""

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick([" | ", " ", " &middot; "]).join(items)

    def junk(self, kind: str, sure: bool = False) -> str:
        r = self.rng
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside"}.get(kind, "div")
        tag = tag if self.semantic and self.chance(0.85) else self.pick(["div", "div", "section"])
        if kind == "nav":
            body = self.links(int(r.integers(3, 12)))
        elif kind == "header":
            body = self.pick([f"<h1>{self.words(1, 5)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 8)}</p>"]) + (self.links(5) if self.chance(0.4) else "")
        elif kind == "footer":
            body = f"&copy; {self.words(1, 3)} &middot; {self.words(3, 14)}." if self.chance(0.7) else f"<p>&copy; {self.words(3, 20)}</p>" + self.links(4)
        elif kind == "side":
            body = f"<h3>{self.words(1, 4)}</h3>" + (self.links(int(r.integers(3, 9))) if self.chance(0.6) else "".join(f"<p>{self.words(5, 40)}.</p>" for _ in range(int(r.integers(1, 4)))))
        elif kind == "ad":
            body = self.pick([f"{self.words(3, 16)}.", f"<p>{self.words(3, 20)}.</p>", f'<a href="//x">{self.words(2, 9)}!</a>'])
        elif kind == "notice":
            body = f"<p>{self.words(6, 40)}.</p>" + ("<button>OK</button>" if self.chance(0.5) else "") if self.chance(0.7) else f"{self.words(6, 30)}."
        elif kind == "comments":
            one = self.pick(["div", "li", "article", "p"])
            rows = "".join(f"<{one}{self.attr(['comment', 'reply', 'comment-body'])}>{self.prose(3, 40)}</{one}>" for _ in range(int(r.integers(1, 6))))
            body = (f"<h3>{self.words(1, 2)}</h3>" if self.chance(0.6) else "") + (f"<ul>{rows}</ul>" if one == "li" else rows)
        elif kind == "form":
            return f'<form data-y="0"{self.attr(["search", "login", "contact-form", "signup"])}><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 12)}</p></form>'
        else:
            body = f"{self.words(1, 3)} {self.words(1, 4)}" if self.chance(0.5) else self.links(4)
        names = JUNK[kind]
        p = 1.0 if sure or tag == "div" and kind in ("ad", "notice", "comments", "side", "share") else 0.7
        return f'<{tag} data-y="0"{self.attr(names, p)}>{body}</{tag}>'

    def article(self) -> str:
        r, parts = self.rng, []
        if self.chance(0.75):
            parts.append(f"<h1>{self.words(1, 12)}</h1>")
        if self.named and self.chance(0.25):
            parts.append(self.junk("share", True))
        for _ in range(int(r.choice([1, 1, 1, 1, 2, 3, 5, 8, 14, 30]))):
            k = r.random()
            if k < 0.72:
                p = self.prose(1, 6) if self.chance(0.35) else self.prose()
                parts.append(f"<p>{p}" + ("</p>" if self.chance(0.9) else "<br>"))
            elif k < 0.79:
                parts.append(f"<h2>{self.words(1, 7)}</h2>")
            elif k < 0.85:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>")
            elif k < 0.89:
                parts.append(f"<blockquote>{self.prose()}</blockquote>")
            elif k < 0.93:
                parts.append(f"<pre>{self.words(3, 30)}</pre>")
            elif k < 0.96:
                parts.append(f"<table><tr><td>{self.words(1, 6)}</td><td>{self.words(1, 6)}</td></tr></table>")
            elif k < 0.98:
                parts.append(f"<figure><figcaption>{self.words(3, 14)}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.prose()}</div>")
            if self.named and self.chance(0.06):  # only what its name gives away
                parts.append(self.junk(self.pick(["ad", "ad", "side", "notice", "share", "form", "nav"]), True))
        if self.named and self.chance(0.12):
            parts.append(self.junk(self.pick(["comments", "share", "side"]), True))
        tag = self.pick(["article", "article", "main", "section"]) if self.semantic and self.chance(0.85) else "div"
        return f'<{tag} data-y="1"{self.attr(MAIN_NAMES, 0.6 if tag != "div" else 0.9)}>{"".join(parts)}</{tag}>'

    def block(self) -> str:
        """One block of running text, of any kind and length."""
        k, r = self.rng.random(), self.rng
        if k < 0.5:
            return f"<p>{self.words(1, 4) + '.' if self.chance(0.3) else self.prose(4, 60)}</p>"
        if k < 0.62:
            return f"<{(h := self.pick(['h2', 'h2', 'h3', 'h4']))}>{self.words(1, 6)}</{h}>"
        if k < 0.74:
            lines = [self.words(1, 7).replace(".", ";") for _ in range(int(r.integers(1, 9)))]
            code = self.pick(["\n", "\n    "]).join(self.pick(["{}", "{} = 1", "if ({}) {{", "$ {}", "{}();"]).format(x) for x in lines)
            return f"<pre><code>{code}</code></pre>" if self.chance(0.5) else f"<pre>{code}</pre>"
        if k < 0.82:
            kind = self.pick(["ul", "ol"])
            return f"<{kind}>" + "".join(f"<li>{self.words(1, 14)}</li>" for _ in range(int(r.integers(1, 6)))) + f"</{kind}>"
        if k < 0.87:
            return f"<blockquote><p>{self.prose(4, 30)}</p></blockquote>" if self.chance(0.6) else f"<blockquote>{self.prose(4, 30)}</blockquote>"
        if k < 0.91:
            rows = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(int(r.integers(1, 5))))
            return f"<table>{rows}</table>"
        if k < 0.94:
            return "<dl>" + "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.words(2, 12)}</dd>" for _ in range(int(r.integers(1, 4)))) + "</dl>"
        if k < 0.97:
            return f"<figure><img src=x><figcaption>{self.words(2, 10)}</figcaption></figure>"
        return f"<div>{self.prose(4, 50)}</div>"

    def bare_page(self) -> str:
        """A page whose text stands in a container without a name, or in none, with little or nothing around it."""
        parts = []
        if self.chance(0.7):
            title = f"<h1>{self.words(1, 8)}</h1>"
            parts.append(f'<header data-y="1">{title}</header>' if self.semantic and self.chance(0.25) else title)
        if self.chance(0.15):  # paragraphs that are plain divisions
            parts += [f"<div>{self.prose(3, 60)}</div>" for _ in range(int(self.rng.integers(1, 7)))]
        else:
            parts += [self.block() for _ in range(int(self.rng.choice([1, 2, 2, 3, 3, 4, 6, 9, 15])))]
        text = "".join(parts)
        if self.chance(0.4):  # sections
            text = f"<{(t := self.pick(['section', 'div']))}>{text}</{t}>" + "".join(f"<{t}><h2>{self.words(1, 5)}</h2>{self.block()}{self.block()}</{t}>" for _ in range(int(self.rng.integers(0, 3))))
        where = self.pick(["main", "article", "div", "div", "div", "section", ""]) if self.semantic else self.pick(["div", "div", ""])
        # Without a container each block carries the label.
        text = f'<{where} data-y="1">{text}</{where}>' if where else f'<body data-y="1">{text}'
        before = [self.junk(k) for k, p in (("header", 0.2), ("nav", 0.35)) if self.chance(p)]
        after = [self.junk(k) for k, p in (("comments", 0.1), ("side", 0.1), ("footer", 0.35)) if self.chance(p)]
        for _ in range(int(self.rng.integers(0, 2))):
            text = f"<div>{text}</div>" if where else text
        if not where:
            return f"<html>{text}{''.join(before)}{''.join(after)}</body></html>"
        return self.pick(["<html><body>{}</body></html>", "{}", "<!DOCTYPE html><body>{}"]).format("".join(before) + text + "".join(after))

    def page(self) -> str:
        if self.chance(0.4):
            return self.bare_page()
        top = [self.junk(k) for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.7), ("form", 0.15), ("ad", 0.4)) if self.chance(p)]
        middle = [self.article()]
        if self.chance(0.1):
            middle.append(self.article())
        for kind, p in (("share", 0.2), ("ad", 0.25), ("comments", 0.35), ("side", 0.3), ("notice", 0.1), ("form", 0.15)):
            if self.chance(p):
                middle.append(self.junk(kind))
        if self.chance(0.2):
            middle.insert(0, self.junk(self.pick(["side", "nav", "ad"])))
        body = "".join(middle)
        for _ in range(int(self.rng.integers(0, 3))):
            body = f"<div{self.attr(['wrapper', 'container', 'page', 'site', 'main'], 0.7)}>{body}</div>"
        end = [self.junk(k) for k, p in (("side", 0.3), ("nav", 0.15), ("footer", 0.8), ("notice", 0.12)) if self.chance(p)]
        tail = "</body></html>" if self.chance(0.9) else ""
        return f"<html><head><title>{self.words(2, 9)}</title></head><body>{''.join(top)}{body}{''.join(end)}{tail}"


def sample_page(rng: np.random.Generator) -> str:
    return _Page(rng).page()
