"""URL filters, token counts, decontamination, quality, extraction, pseudonyms and archives."""

import hashlib
import random
import re

import numpy as np
import pytest

from shelfmark.llm import boosting, dom, html_extract, pii, quality, token_counts, url_filter, warc


# URL filters -----------------------------------------------------------------------------------


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for action, rule in url_filter.HOST_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    if best:
        return host, path, best[1], best[0]
    hit = any(re.search(r.regex, host + path, re.S) for r in url_filter.pattern_rules())
    return host, path, None, "block" if hit else "allow"


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net:80/", "http://ünet/", "HTTP://WWW.Example.NET/en/1?q", "http://example.net/EN/", "http://example.net/english",
        "http://example.com/de/", "http://x.example.com/de/1#a", "http://notexample.com/de/", "http://a.org/fr/", "http://a.org/fr", "http://org/fr/x", "http://a.b/c?d://e.net/", "http://casino-win.example.com/", "http://mycasino.com/casino",
        "http://x.com/a/CASINO", "ftp://u@spam-farm.co#x", "http://cheap-pills.de", "http://cheap-pillsx.de", "http://x/" + "a" * 100000]


def test_url_filter(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS * 2)], "page_id long, url string, path string")
    got = sorted(url_filter.filter_urls(df).collect())
    assert [tuple(r)[2:] for r in got] == [plain_verdict(u) for u in URLS * 2]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("a.example.net/en/",), ("b.example.org/en/",), ("c.example.net/x",)], "t string")
    rules = [*url_filter.host_rules(), url_filter.Rule("block", "*ab*", "*ab*", 1)]
    index = url_filter.rarest_tokens(df, rules, "t")
    assert {t: [r.name for r in rs] for t, rs in index.items()} == {"net": ["net/"], "en": ["example.net/en/"], "com": ["example.com/de/"], "fr": ["org/fr/"], "": ["*ab*"]}
    assert url_filter.matcher(index)("xaby/").name == "*ab*"


# Token counts ----------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_brute_force(spark, rule):
    import base64

    import tiktoken

    v = token_counts.Vocabulary.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.ranks.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "\n", "one\n\n\n  two\n", "é\nü ñandú\n日本語テキスト", "<|endoftext|>\nx", "a" * 3000 + "\n" + " " * 50 + "b\n" * 40]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, section string")
    got = token_counts.section_tokens(df, rule=rule).orderBy("doc_id", "section").collect()
    for i, t in enumerate(texts):
        t = t or ""
        lines = t.splitlines(keepends=True) if t else [""]
        lines = re.findall(r"[^\n]*\n|[^\n]+", t) or [""]
        bounds, at = [], 0
        for x in lines:
            bounds.append((at, at + len(x.encode())))
            at += len(x.encode())
        want, crossing, pos = [0] * len(lines), [0] * len(lines), 0
        for token in enc.encode_ordinary(t):
            end = pos + len(enc.decode_single_token_bytes(token))
            share = [max(0, min(b, end) - max(a, pos)) for a, b in bounds]
            own = next(k for k, s in enumerate(share) if s) if rule == "first" else share.index(max(share))
            want[own] += 1
            crossing[own] += sum(s > 0 for s in share) > 1
            pos = end
        mine = [r for r in got if r.doc_id == (i if i else None)]
        assert [r.n_tokens for r in mine] == want and [r.n_crossing for r in mine] == crossing
        assert "".join(t[r.start_char : r.end_char] for r in mine) == t
    assert token_counts.section_tokens(df.limit(0)).count() == 0


# Quality ---------------------------------------------------------------------------------------


def test_boosting_learns_and_degenerates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    m = boosting.fit(x[:2000], y[:2000])
    assert ((m.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (boosting.fit(x, np.ones(3000)).probability(x) > 0.9).all()
    node = x[:7]
    assert np.allclose(m.margin(node), [m.margin(r[None])[0] for r in node])


def test_quality(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(r.score, known[i]) for i, r in got.items() if r.held_out and i in known]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in quality.classify(df, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()} and quality.accepted(df, labels).columns == df.columns


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "x " * 200000, 3), (2, "x", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.classify(df, labels).count() == 4
    assert {round(r.score, 6) for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), labels).count() == 0 and quality.accepted(df, labels.limit(0)).columns == df.columns


# Extraction ------------------------------------------------------------------------------------


def test_dom_repairs():
    t = dom.parse("<p>a<p>b<ul><li>c<li>d</ul><script>if (a</p>)</script>&amp;&lt<br>e<!-- x --><b>f<div>g")
    assert " ".join(x[2] for x in t.runs) == "a b c d &<   e f g"
    assert dom.parse("<a href='x>y").runs == [] and dom.parse("").tag == []
    assert dom.attributes(' CLASS="a b" id=c hidden x=\'1\' id=d') == {"class": "a b", "id": "c", "hidden": "", "x": "1"}


def test_decoding_is_consistent():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 9
        parent = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]]
        p = rng.random(n)
        kept = html_extract.decode(parent, p, 0, np.ones(n))
        best, top = None, -1e9
        for m in range(1 << (n - 1)):
            k = [True, *[bool(m >> i & 1) for i in range(n - 1)]]
            if all(k[parent[u]] or not k[u] for u in range(1, n)):
                s = sum(np.log(p[u] if k[u] else 1 - p[u]) for u in range(1, n))
                if s > top:
                    best, top = k, s
        assert kept.tolist() == best


def test_extracts_articles(spark, sf):
    import html as h

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_extract.main_text(pages).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_extracts_other_layouts():
    model = html_extract.train()
    prose = "Long words make the main text of this page, as they do. They go on for a while, and then some more of them follow here. "
    page = f"""<body><div id="cookie-banner"><p>We use cookies. Accept all of them, please, or leave.</p></div>
      <div class="site-header"><a href="/">Home</a></div><ul class="menu"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul>
      <div class="content"><h1>Title here</h1><p>{prose * 2}</p><div class="advert">Buy this now.</div><p>{prose}<b>Bold</b> end.</p><ul><li>first point of it</li></ul></div>
      <div class="comments"><h3>Comments</h3><div class="comment"><p>Nice article, thank you for it.</p></div></div>
      <aside><h3>Related</h3><a href="/3">Another story</a></aside><footer>&copy; 2024 Someone. All rights.</footer></body>"""
    got = html_extract.extract([page], model)[0]
    assert got.startswith("Title here\nLong words") and "Bold end." in got and "first point" in got
    for junk in ("cookies", "Home", "Two", "Buy this", "Nice article", "Related", "Someone"):
        assert junk not in got


def test_extract_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<div>" * 3000 + "x"), (4, "<html><head><title>t"), (5, "a < b &am &#x41;"), (5, "a < b &am &#x41;")]
    df = spark.createDataFrame([(i, h, "old") for i, h in rows], "page_id long, html string, text string")
    got = html_extract.main_text(df).collect()
    assert len(got) == 6 and all(r.text is not None for r in got) and {r.text for r in got if r.page_id in (1, 2, 4)} == {""}
    assert html_extract.main_text(df.limit(0)).count() == 0


# Pseudonyms ------------------------------------------------------------------------------------


def luhn(d):
    d = [int(x) for x in d][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_found string")
    out = pii.pseudonymised(df, key, count="n")
    assert out.columns == ["doc_id", "text", "pii_found", "n"]
    return [(r.text, r.n) for r in out.orderBy("doc_id").collect()]


def test_pseudonyms_keep_formats(spark):
    texts = ["card 4111111111111111, again 4111-1111-1111-1111", "bad 4111111111111112", "ip 97.51.17.173 no 999.1.1.1", "und.34@mail7.example.com é.Ü9@x.org", "+1 (017) 555-7713", "123-45-6789 000-12-1234",
             'TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"', 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "GB82WEST12345698765432", "2024-02-29 2023-02-29 31.12.1999", "clean 4.0 text\n12 apples", "", None]
    got = replaced(spark, texts)
    a = re.findall(r"[\d-]{16,}", got[0][0])
    assert a[0] == a[1].replace("-", "") != "4111111111111111" and luhn(a[0]) and re.fullmatch(r"(\d{4}-){3}\d{4}", a[1])
    assert got[1] == (texts[1], 0) and "999.1.1.1" in got[2][0] and got[2][1] == 1
    assert all(int(x) < 256 for x in re.search(r"ip ([\d.]+)", got[2][0])[1].split(".")) and "97.51.17.173" not in got[2][0]
    assert re.fullmatch(r"[a-z]{3}\.\d\d@mail7\.example\.com \S\.\S\d@x\.org", got[3][0])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[4][0]) and got[5][0].endswith(" 000-12-1234") and got[5][1] == 1
    assert re.fullmatch(r'TOKEN = "[0-9A-Z]{40}"', got[6][0]) and re.fullmatch(r'token = "[0-9a-f]{40}"', got[7][0]) and "24be" not in got[7][0]
    moved = got[8][0][4:] + got[8][0][:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and got[8][0] != texts[8]
    assert " 2023-02-29 " in got[9][0] and got[9][1] == 2
    assert got[10:] == [(texts[10], 0), ("", 0), (None, 0)]
    assert replaced(spark, texts[:1], "other key") != got[:1]


def test_pseudonyms_are_permutations(spark):
    rnd = random.Random(8)
    days = [f"{y}-{m:02}-{d:02}" for y in range(1990, 1994) for m in range(1, 13) for d in range(1, 29)]
    ips = sorted({".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(1500)})
    for values in (days, ips):
        got = [t for t, _ in replaced(spark, values)]
        assert len(set(got)) == len(values) and sum(a == b for a, b in zip(got, values, strict=True)) < 3


def test_pseudonyms_of_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in df.collect()}
    after = {r.doc_id: r for r in pii.pseudonymised(df, "k", count="n").collect()}
    for i, t in before.items():
        found = [m[0] for m in re.finditer(r"\S+@\S+\.com|\d+\.\d+\.\d+\.\d+|\+1 \(\d+\) \S{8}|\"[0-9a-f]{40}\"", t)] + [m for m in re.findall(r"\b\d{16}\b", t) if luhn(m)]
        assert all(x not in after[i].text for x in found) and (after[i].text == t) == (not found)


# Archives --------------------------------------------------------------------------------------


def test_round_trip_against_brute_force(spark, tmp_path):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "u", "small"), (8, "u", "small"), (7, "u", None), (6, "ü", ""), (4, "v", "x" * 300000), (3, None, big), (None, "n", big), (2, "P*M\x18", "P*M\x18\0\0\0\0" * 40)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    got = sorted(warc.round_trip(df, path=path).collect(), key=str)
    want = []
    for k, (i, _, h) in enumerate(rows):
        raw = (h or "").encode()
        same = [j for j, _, x in rows if x == h and j is not None]
        lead = len(raw) < 100 or (i == min(same) and k == next(n for n, r in enumerate(rows) if r[0] == i and r[2] == h))
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if lead else "revisit", None if lead else min(same)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    back = {r.record_id: r for r in warc.read_archives(spark, path).collect() if r.record_type == "response"}
    assert bytes(back["4"].payload) == b"x" * 300000 and back["2"].target_uri == "P*M%18" and back["5" if "5" in back else "3"].payload_bytes == len(big.encode())
    assert warc.round_trip(df.limit(0), path=str(tmp_path / "e")).count() == 0


def test_archive_reader_validates():
    import zstandard

    payload = b"hello" * 40
    good = warc.record("1", "http://x", payload, hashlib.sha256(payload).hexdigest(), None)
    assert warc.parse_record(good)["payload"] == payload
    for bad in (good[:-1], good[:-10], good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"hellohello", b"hellohellO"), good.replace(b"response\r\nWARC-Record", b"resource\r\nWARC-Record")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)
    dictionary = zstandard.train_dictionary(2000, [b"some text %d of a page" % i * 20 for i in range(200)])
    pack = zstandard.ZstdCompressor(dict_data=dictionary)
    for body in (dictionary.as_bytes(), zstandard.compress(dictionary.as_bytes())):  # plain and compressed dictionaries
        data = warc.DICT_FRAME + len(body).to_bytes(4, "little") + body + pack.compress(good) + warc.SEPARATOR.encode() + pack.compress(good)
        assert list(warc.frames(data)) == [good, good]
        for cut in (data[:-3], data[:5], data[:-20] + b"garbage", data + b"xx"):
            with pytest.raises(warc.BadArchive):
                list(warc.frames(cut))


# Pipeline --------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline
    from test_dedup import norm
    from test_simhash_wide import shingles

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    ok = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in ok)
    first = {}
    for i, t in rows:
        first.setdefault(norm(t), i)
    rows = [(i, t) for i, t in rows if first[norm(t)] == i]
    items = [r.text for r in bench.collect()]
    whole = corpus_pipeline.run(spark, sf)
    got = {r.doc_id for r in whole.collect()}
    assert whole.columns == [*docs.columns, "copies", "taken"]
    clean = {i for i, t in rows if not any(x in t for x in items)}
    assert got <= clean and len(got) > 0.5 * len(rows)
    sets = {i: shingles(t) for i, t in rows if i in got}
    assert not any(len(a & b) > 0.9 * len(a | b) for i, a in sets.items() for k, b in sets.items() if i < k)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
