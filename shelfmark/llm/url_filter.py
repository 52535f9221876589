"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is matched against host + path of a URL. ``||`` at its start anchors it at a label of the
host (the host itself and all subdomains), ``|`` at either end anchors it there, ``*`` is any run of
characters and ``^`` a separator (a character that is no ASCII letter or digit, or either end).
Anything else is literal. A literal run of letters and digits is a token of the pattern if neither
end of it can continue in a matching URL. Each rule is filed under the token that is rarest in the
URLs themselves; a URL's tokens fetch the rules filed under them, and only these run their regular
expression. Rules without a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The contract's rules, as action and pattern. Their names are host and path.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Patterns of our own for URLs that no host rule fits; the longest that matches decides.
PATTERN_RULES = (
    ("block", "||casino-*^"),
    ("block", "||cheap-pills."),
    ("block", "||free-bets."),
    ("block", "||spam-*^"),
    ("block", "||adult-*^"),
    ("block", "||ads-track."),
    ("block", "^casino^"),
    ("block", "^xxx^"),
    ("block", "^porn^"),
    ("block", "^doubleclick^"),
)


@dataclass(frozen=True)
class Rule:
    action: str
    name: str
    pattern: str
    tier: int  # a rule of a lower tier decides before any of a higher one

    @property
    def regex(self) -> str:
        p, start, end = self.pattern, "", ""
        if p.startswith("||"):
            p, start = p[2:], r"^(?:[^/]*\.)?"
        elif p.startswith("|"):
            p, start = p[1:], "^"
        if p.endswith("|"):
            p, end = p[:-1], r"\Z"
        parts = {"*": ".*?", "^": r"(?:[^0-9A-Za-z]|^|\Z)"}
        return start + "".join(parts.get(c, re.escape(c)) for c in p) + end

    @property
    def tokens(self) -> list[str]:
        p = self.pattern
        body = p[2:] if p.startswith("||") else p.removeprefix("|")
        anchored = body != p
        body, ended = (body[:-1], True) if body.endswith("|") else (body, False)
        out = []
        for m in re.finditer(r"[0-9A-Za-z]+", body):
            before = body[m.start() - 1] if m.start() else ("^" if anchored else "*")
            after = body[m.end()] if m.end() < len(body) else ("^" if ended else "*")
            if before != "*" and after != "*" and not before.isalnum() and not after.isalnum():
                out.append(m[0].lower())
        return out


def host_rules(rules=HOST_RULES) -> list[Rule]:
    return [Rule(action, name, f"||{name}", 0) for action, name in rules]


def pattern_rules(rules=PATTERN_RULES) -> list[Rule]:
    return [Rule(action, p, p, 1) for action, p in rules]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, az, az.lower()), path


def rarest_tokens(urls: DataFrame, rules: list[Rule], column: str) -> dict[str, list[Rule]]:
    """Files each rule under its token that occurs in fewest values of ``column``; "" if it has none.

    Tokens are counted over all rows; what comes to the driver is one count per token of the rules.
    """
    known = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if known:
        some = F.array_intersect(F.split(F.lower(F.col(column)), "[^0-9a-z]+"), F.array(*[F.lit(t) for t in known]))
        rows = urls.select(F.explode(some).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
        counts = {r["t"]: r["n"] for r in rows}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def matcher(index: dict[str, list[Rule]]):
    """A function from host + path to the rule that decides, or None."""
    compiled = {t: [(r.tier, -len(r.name), r.name, r, re.compile(r.regex, re.S)) for r in rs] for t, rs in index.items()}
    always, cut = compiled.pop("", []), re.compile(r"[0-9A-Za-z]+")

    def judge(url: str) -> Rule | None:
        best = None
        tokens = {t.lower() for t in cut.findall(url)}
        for group in (always, *(compiled[t] for t in tokens if t in compiled)):
            for c in group:
                if (best is None or c[:3] < best[:3]) and c[4].search(url):
                    best = c
        return best[3] if best else None

    return judge


def filter_urls(df: DataFrame, url: str = "url", rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to each row (columns of these names are replaced).

    Host rules decide first, the longest that fits; then patterns, the longest that matches; else
    ``default``. ``rule`` is the host rule's string or null. A null URL and one without ``://`` have
    empty host and path, match nothing and get the default. Rows are kept as they are, repeats too.
    """
    rules = [*host_rules(), *pattern_rules()] if rules is None else rules
    cols = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    target, judged = free_name(df, "url_target"), free_name(df, "url_judged")
    host, path = split_url(F.col(url))
    out = df.select(*[F.col(f"`{c}`") for c in cols], host.alias("host"), path.alias("path"))
    out = out.withColumn(target, F.concat("host", "path"))
    index = rarest_tokens(out, rules, target)

    @F.pandas_udf("rule string, verdict string")
    def judge(targets: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = matcher(index)
        for batch in targets:
            hits = [of(t) for t in batch]
            yield pd.DataFrame(
                {
                    "rule": pd.Series([h.name if h and h.tier == 0 else None for h in hits], dtype=object),
                    "verdict": pd.Series([h.action if h else default for h in hits], dtype=object),
                }
            )

    out = out.withColumn(judged, judge(F.col(target)))
    return out.select(*[F.col(f"`{c}`") for c in cols], "host", "path", f"{judged}.rule", f"{judged}.verdict")
