"""Queries as values, and their predicates."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as fn
from ..schema import KINDS
from .regex import check_length, literals, quoted, to_java


class FileSort(StrEnum):
    NONE = "none"
    SIZE_ASC = "size-asc"
    SIZE_DESC = "size-desc"
    ATTR_ASC = "attr-asc"

    @classmethod
    def parse(cls, text: str) -> FileSort:
        return cls({"relevance": "none", "size": "size-asc", "attr": "attr-asc"}.get(text, text))


@dataclass(frozen=True)
class LocateQuery:
    """What to look for among files. ``package`` filters package names (a regular expression if
    ``regex``), sizes are inclusive bytes, ``types`` empty means all. ``basename`` is the exact last part
    of the path, ``path_prefix`` what the path starts with, ``labels`` the packages to look at (empty: all)."""

    pattern: str
    regex: bool = False
    package: str | None = None
    hash: str | None = None
    all: bool = False
    types: tuple[str, ...] = ()
    group: bool = True
    whole_name: bool = False
    at_root: bool = False
    minimal: bool = False
    limit: int | None = None
    sort: FileSort = FileSort.NONE
    min_size: int | None = None
    max_size: int | None = None
    exclude_fhs: bool = False
    ignore_case: bool = False
    basename: str | None = None
    path_prefix: str | None = None
    labels: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        check_length(self.pattern)
        if bad := set(self.types) - set(KINDS):
            raise ValueError(f"unknown file types: {sorted(bad)}")
        if self.limit is not None and self.limit < 0:
            raise ValueError("limits are not negative")

    @property
    def grouped(self) -> bool:
        return self.group and not self.minimal

    @property
    def only_toplevel(self) -> bool:
        return not self.all and not self.minimal

    def with_pattern(self, pattern: str) -> LocateQuery:
        return replace(self, pattern=pattern)


def _root(pattern: str) -> str:
    return pattern if pattern.startswith("/") else f"/{pattern}"


def anchored(q: LocateQuery) -> str:
    """The Java pattern of a query's path."""
    body = _root(q.pattern) if q.at_root else q.pattern
    if not q.regex:
        return ("^" if q.at_root else "") + quoted(body) + (r"\z" if q.whole_name else "")
    if q.at_root or q.whole_name:
        body = ("^" if q.at_root else "") + f"(?:{body})" + ("$" if q.whole_name else "")
    return to_java(body, q.ignore_case)


def path_predicate(q: LocateQuery, path: Column) -> Column:
    """Literals become native string predicates, which reach the Parquet scan; a regular expression
    gets the literals that each match contains as conjuncts, for the same reason."""
    if not q.regex:
        text = _root(q.pattern) if q.at_root else q.pattern
        if q.at_root and q.whole_name:
            return path == text
        if q.at_root:
            return path.startswith(text)
        return path.endswith(text) if q.whole_name else path.contains(text)
    out = path.rlike(anchored(q))
    if not q.ignore_case:
        for text in dict.fromkeys(x for x in literals(q.pattern) if x):
            out = path.contains(text) & out
    return out


def group_predicate(q: LocateQuery, path: Column) -> Column:
    """Keeps an entry if no slash follows the last match: descendants of a match are left out."""
    if not q.pattern:
        return F.lit(True)
    rest = F.element_at(F.split(path, anchored(q), -1), -1)
    return ~rest.contains("/")


def file_predicate(q: LocateQuery, path: Column, kind: Column, size: Column) -> Column:
    out = path_predicate(q, path)
    if q.basename is not None:
        out = out & (fn.basename(path) == q.basename)
    if q.path_prefix:
        out = out & path.startswith(q.path_prefix)
    if q.types:
        out = out & kind.isin(*q.types)
    if q.min_size is not None:
        out = out & (size >= q.min_size)
    if q.max_size is not None:
        out = out & (size <= q.max_size)
    return out & group_predicate(q, path) if q.grouped else out


def package_predicate(q: LocateQuery, name: Column, hash_: Column, toplevel: Column, label: Column | None = None) -> Column:
    out = F.lit(True)
    if q.labels and label is not None:
        out = out & label.isin(*q.labels)
    if q.package is not None:
        check_length(q.package)
        out = out & (name.rlike(to_java(q.package)) if q.regex else name.contains(q.package))
    if q.hash is not None:
        out = out & (hash_ == q.hash)
    if q.only_toplevel:
        out = out & toplevel
    if q.exclude_fhs:
        out = out & ~name.contains("-fhs") & ~name.contains("-usr-target")
    return out


class Access(StrEnum):
    """The table that a query's entries are read from, most specific first."""

    PATH = "path"  # entries sorted by path: one path, or those with a prefix
    BASENAME = "basename"  # entries sorted by basename
    TRIGRAMS = "trigrams"  # paths that hold all trigrams of the query's literals
    PATHS = "paths"  # distinct paths, for literals too short for trigrams
    SCAN = "scan"


def fixed_texts(q: LocateQuery) -> tuple[str, ...]:
    """Literals that the path of every hit contains."""
    if q.ignore_case:
        return ()
    if q.regex:
        return tuple(dict.fromkeys(x for x in literals(q.pattern) if x))
    return (q.pattern,) if q.pattern else ()


def access_of(q: LocateQuery) -> Access:
    if not q.regex and not q.ignore_case and q.at_root or q.path_prefix:
        return Access.PATH
    # A whole name with a slash in it gives the basename away.
    if q.basename is not None or (q.whole_name and not q.regex and not q.ignore_case and "/" in q.pattern):
        return Access.BASENAME
    texts = fixed_texts(q)
    if any(len(t.encode()) >= 3 for t in texts):
        return Access.TRIGRAMS
    return Access.PATHS if texts else Access.SCAN


class Field(StrEnum):
    ATTR = "attr"
    DESCRIPTION = "description"
    MAIN_PROGRAM = "main-program"
    BOTH = "both"

    @property
    def columns(self) -> tuple[str, ...]:
        every = ("attr", "description", "main_program")
        return every if self is Field.BOTH else (self.value.replace("-", "_"),)


class MetaSort(StrEnum):
    NONE = "none"
    ATTR = "attr"
    ATTR_DESC = "attr-desc"
    NAME = "name"
    NAME_DESC = "name-desc"
    MAIN_PROGRAM = "main-program"
    MAIN_PROGRAM_DESC = "main-program-desc"


@dataclass(frozen=True)
class MetaQuery:
    """What to look for among package metadata; the default order is by relevance."""

    pattern: str
    field: Field = Field.BOTH
    regex: bool = False
    exact: bool = False
    fuzzy: bool = False
    case_sensitive: bool = False
    sort: MetaSort = MetaSort.NONE
    limit: int | None = None

    def __post_init__(self) -> None:
        check_length(self.pattern)
        if self.fuzzy and (self.regex or self.exact):
            raise ValueError("fuzzy search is neither regex nor exact")
