"""Stages and operators on rows with extra columns whose names clash or hold dots."""

import pytest
from pyspark.sql import types as T

from shelfmark.llm import decontaminate, exact_dedup, html_extract, mixing, pii, quality, simhash, simhash_wide, token_counts, url_filter, warc

EXTRA = ("a.b", "row_key", "score", "copies", "taken", "key", "id", "comp", "fp", "src", "size", "rest", "node", "h", "uid", "class", "url_target", "_url", "host2", "left", "n", "grp", "name", "level", "page", "digest")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in EXTRA]])
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(WORDS[i % 7 :]) + f" x{i // 2}", "ab"[i % 2], "http://a.net/x", "<p>hello</p>") for i in range(12)]
    rows += [rows[0], (None, None, None, None, None), (20, "", "a", "", ""), (21, "w " * 150_000, "b", "http://" + "a/" * 50_000, "<p>" + "w " * 150_000 + "</p>")]
    return spark.createDataFrame([(*r, *range(len(EXTRA))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", ["exact", "near", "wide", "leaks", "quality", "mixing"])
def test_stages_keep_columns(spark, docs, labels, name, empty):
    df = docs.limit(0) if empty else docs
    bench = spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string")
    out = {
        "exact": lambda: exact_dedup.drop_exact_duplicates(df), "near": lambda: simhash.drop_near_duplicates(df), "wide": lambda: simhash_wide.drop_near_copies(df),
        "leaks": lambda: decontaminate.drop_leaks(df, bench), "quality": lambda: quality.accepted(df, labels), "mixing": lambda: mixing.mixed_rows(df),
    }[name]()
    more = ["_copies", "_taken"] if name == "mixing" else []
    assert out.columns == [*df.columns, *more]
    rows = out.collect()
    assert (not rows) if empty else rows and {tuple(r[c] for c in EXTRA) for r in rows} == {tuple(range(len(EXTRA)))}


def test_operators_ignore_or_keep_columns(spark, docs, labels, tmp_path):
    n = docs.count()
    assert url_filter.filter_urls(docs).columns == [*docs.columns, "host", "path", "rule", "verdict"] and url_filter.filter_urls(docs).count() == n
    assert pii.pseudonymised(docs, "k").columns == docs.columns and pii.pseudonymised(docs, "k").count() == n
    assert html_extract.main_text(docs, out="main").columns == [*docs.columns, "main"] and html_extract.main_text(docs, out="main").count() == n
    assert token_counts.section_tokens(docs).where("doc_id = 21").selectExpr("sum(n_tokens)").first()[0] > 100_000
    for out in (mixing.mix(docs), exact_dedup.exact_duplicates(docs), simhash.near_duplicates(docs), quality.classify(docs, labels)):
        assert out.count() == n
    assert warc.round_trip(docs, id_col="doc_id", path=str(tmp_path / "w")).count() == n
