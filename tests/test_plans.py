"""Regular expressions, literals, and predicates against a plain model of the full scan."""

import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import fuzzy
from shelfmark.functions import text as fn
from shelfmark.operators import locate
from shelfmark.plans.query import FileSort, LocateQuery, MetaQuery
from shelfmark.plans.regex import literals, quoted, to_java


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("bin/.*test$", ("bin/", "test")), ("^bin/ls$", ("bin/ls", "bin/ls")), (r"bin/\.config", ("bin/.config", "bin/.config")), (r"bin/.*\.config", ("bin/", ".config")),
        ("(bin/)firefox", ("bin/firefox", "bin/firefox")), ("(firefox|thunderbird)", (None, None)), ("ab.*", (None, None)), (".*", (None, None)), ("bin/.*ab", ("bin/", None)),
        ("(bin.*)ls", ("bin", None)), ("(?i)bin/ls", (None, None)), ("a*bin", (None, "bin")), ("b.n", (None, None)), ("[", (None, None)),
    ],
)
def test_literals(pattern, want):
    assert literals(pattern) == want


def test_dialect(spark):
    df = spark.createDataFrame([("ab\n",), ("ab",), ("é9",), ("a\rb",), ("x&[y",)], "s string")
    hits = lambda p, **k: {r.s for r in df.where(F.col("s").rlike(to_java(p, **k))).collect()}
    assert hits("b$") == {"ab", "a\rb"} and hits("a.b") == {"a\rb"} and hits(r"^\w\d$") == {"é9"} and hits("É", ignore_case=True) == {"é9"}
    assert hits(r"[&\[]y") == {"x&[y"} and hits("[]&]") == {"x&[y"} and hits("[^a-z]9") == {"é9"}
    assert hits("^[[:alpha:]]+$") == {"ab"} and hits("[[:^alpha:]]$") == {"ab\n", "é9"} and hits("^[a-z&&[^b]]b$") == {"ab"} and hits("(?P<n>a)b$") == {"ab"}
    assert hits(r"^\p{L}[0-9]$") == {"é9"} and hits(r"\x{e9}|\u00e9") == {"é9"} and hits("(?i)AB$") == {"ab"} and hits(r"^\p{Latin}\d") == {"é9"}
    for bad in ("[&[]y", "[a--b]", "[a~~b]", "(?x)a b", r"\Qa", "(?>a)", "a++", "[[:none:]]", "a{3,1}", "(a", r"\p{Nothing}", "*a", r"(?<n>a)\k<n>"):
        with pytest.raises(ValueError):
            to_java(bad)
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "a\\", "[a", "x" * 1025):
        with pytest.raises(ValueError):
            to_java(bad)


PATHS = ["", "/bin", "/bin/ls", "/bin/als", "/usr/bin/ls", "/lib/a/b", "/a/a/", "/x.y", "/xzy", "/bin/nested/ls", "/Bin/LS", "/a\\b", "/é/ls", "/bin/ls.d/x"]


def model(q: LocateQuery, path: str) -> bool:
    body = ("/" + q.pattern.lstrip("/") if q.at_root and not q.pattern.startswith("/") else q.pattern) if True else ""
    p = body if q.regex else re.escape(body)
    p = ("^" if q.at_root else "") + f"(?:{p})" + (r"\Z" if q.whole_name else "")
    found = list(re.finditer(p, path))
    if not found:
        return False
    return not q.grouped or not q.pattern or "/" not in path[found[-1].end() :]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.one_of(st.tuples(st.sampled_from(["ls", "bin/", "/a/", ".", "bin/ls", "x.y", "/", "nested", "a\\b", "é", "LS"]), st.just(False)), st.tuples(st.sampled_from(["bin/.s", "l[st]", "x.y", "(bin|lib)/", "/a", "b.n/ls", "ls"]), st.just(True))),
    st.booleans(), st.booleans(), st.booleans(),
)
def test_predicates_equal_the_scan(spark, pattern, root, whole, group):
    q = LocateQuery(pattern[0], regex=pattern[1], at_root=root, whole_name=whole, group=group, all=True)
    files = spark.createDataFrame([(1, p, "x", 5, None) for p in PATHS], "pkg_id long, path string, kind string, size long, target string")
    packages = spark.createDataFrame([(1, "a", "out", True, "/store", "h", "n-1")], "pkg_id long, attr string, output string, toplevel boolean, store_dir string, hash string, name string")
    got = sorted(r.path for r in locate.locate(files, packages, q).collect())
    assert got == sorted(p for p in PATHS if model(q, p)), q


def test_query_checks():
    for bad in ({"pattern": "x" * 1025}, {"pattern": "a", "types": ("z",)}, {"pattern": "a", "limit": -1}):
        with pytest.raises(ValueError):
            LocateQuery(**bad)
    with pytest.raises(ValueError):
        MetaQuery("a", fuzzy=True, regex=True)
    assert FileSort.parse("size") is FileSort.SIZE_ASC and FileSort.parse("relevance") is FileSort.NONE


def test_functions(spark):
    df = spark.createDataFrame([("/top-x/st/abc-hello-2.1", 1234567, "/bin/ls"), ("nodash", 12, ""), ("h-n", 0, "/a/")], "p string, n long, f string")
    rows = df.select(fn.parse_store_path(F.col("p")).alias("q"), fn.grouped(F.col("n")).alias("g"), fn.basename(F.col("f")).alias("b"), fn.dirname(F.col("f")).alias("d")).collect()
    assert tuple(rows[0].q) == ("/top-x/st", "abc", "hello-2.1") and rows[1].q is None and tuple(rows[2].q) == ("", "h", "n")
    assert [r.g for r in rows] == ["1,234,567", "12", "0"] and [r.b for r in rows] == ["ls", "", ""] and [r.d for r in rows] == ["/bin", "", "/a"]
    one = spark.range(1).select(
        fn.percent_encoded(F.lit("a b*~/é")).alias("e"), fn.trigrams(F.lit("abcab")).alias("t"), fn.trigrams(F.lit("ab")).alias("u"),
        fn.text_line(F.lit("a.out"), F.lit(1000), F.lit("x"), F.lit("/bin/a")).alias("l"), fn.highlighted(F.lit("a-b-a"), quoted("a")).alias("h"),
        fn.main_program_ok(F.lit("foo/bar")).alias("m"), fn.main_program_ok(F.lit("foo")).alias("k"),
    ).first()
    assert one.e == "a%20b%2A~%2F%C3%A9" and one.t == ["616263", "626361", "636162"] and one.u == [] and not one.m and one.k
    assert one.l == "a.out" + " " * 36 + " " * 8 + " 1,000 x /bin/a" and one.h == "\x1b[31ma\x1b[0m-b-\x1b[31ma\x1b[0m"


def test_fuzzy():
    s = lambda t: fuzzy.score_of("nvim", t)
    assert s("nvim") > s("nvim-x") > s("neovim") > s("n-e-o-v-i-m") > 0 == s("vim") == s(None) == s("")


def every_placement(needle, text):
    """Best fuzzy score by trying all places of the needle's characters."""
    low, n = text.lower(), needle.lower()
    best = 0
    for spots in itertools.combinations(range(len(text)), len(n)):
        if all(low[i] == c for i, c in zip(spots, n, strict=True)):
            score = 0
            for k, i in enumerate(spots):
                score += fuzzy.HIT + (fuzzy.START if i == 0 else fuzzy.BOUNDARY if not text[i - 1].isalnum() else 0)
                if k:
                    gap = i - spots[k - 1] - 1
                    score += fuzzy.RUN if not gap else -fuzzy.GAP * gap
            best = max(best, score + (fuzzy.WHOLE if n == low else 0))
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("ab-C", min_size=1, max_size=3), st.text("abc-C ", max_size=9))
def test_fuzzy_scores_are_the_best_placement(needle, text):
    assert fuzzy.score_of(needle, text) == every_placement(needle, text)
    batch = [None, "", text, text + "-" + needle, needle]
    for case in (False, True):
        assert fuzzy.scores_of(needle, batch, case).tolist() == [fuzzy.score_of(needle, t, case) for t in batch]
