"""Search over package metadata: filters, relevance, fuzzy ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..plans.query import MetaQuery, MetaSort
from ..plans.regex import to_java

#: Points for an equal, a leading and any other hit.
POINTS = {"attr": (3000, 2000, 1000), "description": (300, 200, 100), "main_program": (300, 200, 100)}


def _java(q: MetaQuery) -> str:
    return to_java(f"^(?:{q.pattern})$" if q.exact else q.pattern, not q.case_sensitive)


def _sides(q: MetaQuery, name: str) -> tuple[Column, Column]:
    if q.case_sensitive:
        return F.col(name), F.lit(q.pattern)
    return F.lower(name), F.lower(F.lit(q.pattern))


def matches(q: MetaQuery) -> Column:
    out = None
    for name in q.field.columns:
        text, wanted = _sides(q, name)
        if q.regex:
            one = F.col(name).rlike(_java(q))
        elif q.exact:
            one = text == wanted
        else:
            one = text.contains(wanted)
        one = F.coalesce(one, F.lit(False))
        out = one if out is None else out | one
    return out


def relevance(q: MetaQuery) -> Column:
    """Points summed over the fields searched; a null field has none."""
    total = F.lit(0)
    for name in q.field.columns:
        whole, lead, some = POINTS[name]
        if q.regex:
            java = _java(q)
            at = F.regexp_instr(F.col(name), F.lit(java))
            size = F.length(F.regexp_extract(F.col(name), java, 0))
            one = F.when((at == 1) & (size == F.length(name)), whole).when(at == 1, lead).when(at > 1, some)
        else:
            text, wanted = _sides(q, name)
            one = F.when(text == wanted, whole)
            if not q.exact:
                one = one.when(text.startswith(wanted), lead).when(text.contains(wanted), some)
        total = total + F.coalesce(one, F.lit(0))
    return total


def _order(sort: MetaSort) -> list:
    if sort is MetaSort.NONE:
        return [F.desc("score"), "attr", "meta_ord"]
    name = sort.value.removesuffix("-desc").replace("-", "_")
    key = F.coalesce(F.col(name), F.lit(""))
    return [key.desc() if sort.value.endswith("-desc") else key.asc(), "meta_ord"]


def search(meta: DataFrame, q: MetaQuery, ordered: bool = True) -> DataFrame:
    """The records that a query finds, with ``score``, in its order."""
    if q.fuzzy:
        return _fuzzy(meta, q)
    out = meta.where(matches(q)).withColumn("score", relevance(q))
    if q.limit is None and not ordered:
        return out
    out = out.orderBy(*_order(q.sort))
    return out if q.limit is None else out.limit(q.limit)


def _fuzzy(meta: DataFrame, q: MetaQuery) -> DataFrame:
    """Scores only what passes the native subsequence filter; the best field counts."""
    cols = q.field.columns
    keep, scores = None, []
    of = fuzzy.scorer(q.pattern, q.case_sensitive)
    for name in cols:
        one = fuzzy.subsequence(F.col(name), q.pattern, q.case_sensitive)
        keep = one if keep is None else keep | one
        scores.append(of(F.col(name)))
    out = meta.where(keep).withColumn("score", F.greatest(*scores) if len(scores) > 1 else scores[0]).where("score > 0")
    lead = [] if q.sort is MetaSort.NONE else _order(q.sort)[:1]
    out = out.orderBy(*lead, F.desc("score"), "meta_ord")
    return out if q.limit is None else out.limit(q.limit)


def info(meta: DataFrame, attr: str) -> DataFrame:
    """The first record of an attribute (case-sensitive), or none."""
    return meta.where((F.lower("attr") == attr.lower()) & (F.col("attr") == attr)).orderBy("meta_ord").limit(1)
