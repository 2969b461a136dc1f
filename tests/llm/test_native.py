"""The native operators against their SQL, and on odd rows."""

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from fluxframe.llm import decontaminate as dc
from fluxframe.llm import quality_rules as qr
from fluxframe.llm import secrets
from fluxframe.llm import url_filter as uf
from fluxframe.llm.common import connected_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query,sql", [(qr.quality_rules_query, qr.ORACLE), (secrets.secrets_query, secrets.ORACLE), (dc.decontamination_query, dc.ORACLE), (uf.url_filter_query, uf.ORACLE)])
def test_agrees_with_sql(spark, query, sql):
    assert_same(query(spark, SF), sql, SF)


@pytest.mark.parametrize("query", [qr.quality_rules_query, dc.decontamination_query, uf.url_filter_query, secrets.secrets_query])
def test_plan_has_no_python(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (None, 1), (4, None), (2, 1), (100, 99)] + [(200, i) for i in range(201, 400)] + [(i, i + 1) for i in range(500, 560)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()))
    want = {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 99: 99, 100: 99} | dict.fromkeys(range(200, 400), 200) | dict.fromkeys(range(500, 561), 500)
    assert got == want
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_quality_rules_on_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(100_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t\n", "", "a"), (4, "one two three four five " * 2, "en", "a"), (5, long, "en", "a"), (5, long, "en", "a"), (None, "été " * 12, "fr", "b"), (7, "a b c d e f g h i j\nx\n \nx", "en", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, text string, lang string, source string, kept int, n_words int")
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.quality_rules(df).collect()}
    assert got == {(1, 0, 0, 0, 0, 0, True), (2, 0, 0, 0, 0, 0, True), (3, 0, 0, 0, 0, 0, True), (4, 10, 38, 0, 0, 10, True), (5, 100_000, 888_890, 0, 0, 0, False), (None, 12, 36, 0, 0, 12, True), (7, 12, 12, 0, 1, 0, False)}
    assert qr.quality_rules(df).count() == 8 and qr.quality_rules(df.limit(0)).count() == 0


def _measured(spark, rows):
    """Rows as quality_rules measures them, from (n_symbols in a thousand letters, source)."""
    v = spark.createDataFrame(rows, "n_symbols bigint, _source string").withColumns({"word_chars": F.lit(1000).cast("bigint"), "_lang": F.lit("en")})
    return v.withColumns({c: F.lit(k).cast("bigint") for c, k in (("n_dup_lines", 0), ("n_lines", 1), ("n_repeat_words", 0), ("n_words", 100), ("n_upper", 0), ("n_marks", 0))})


def test_fences_follow_the_group(spark):
    rows = [(i, "a") for i in range(300)] + [(i, "b") for i in range(300, 400)] + [(900, "one")]
    got = {r._source: r for r in qr.fences(_measured(spark, rows), "_lang", "_source", prior=100).collect()}
    whole = sorted(v for v, _ in rows)
    stats = lambda v: (np.median(v), np.mean(np.maximum(np.array(v) - np.median(v), 0)), np.mean(np.maximum(np.median(v) - np.array(v), 0)))
    for source in ("a", "b", "one"):  # every group is drawn towards the whole by its rows, without a step
        own = [v for v, s in rows if s == source]
        med, up, down = ((len(own) * x + 100 * y) / (len(own) + 100) for x, y in zip(stats(own), stats(whole), strict=True))
        assert got[source].hi_symbols == pytest.approx(med + qr.SPREAD * up, rel=0.06)
        assert got[source].lo_symbols == pytest.approx(med - qr.SPREAD * down, rel=0.15)
    assert got["a"].hi_upper == got["a"].lo_upper == 0


def test_one_text_gets_the_verdict_of_its_source(spark):
    prose = "the quick brown fox jumps over a lazy dog near the old mill by the river " + " ".join(f"w{i}" for i in range(40))
    marked = prose + " #### " * 12
    rows = [(i, f"{prose} {i}", "en", "prose") for i in range(400)] + [(1000 + i, f"{marked} {i}", "en", "code") for i in range(400)] + [(1, marked, "en", "prose"), (2, marked, "en", "code")]
    df = spark.createDataFrame([(5000 + i, *r[1:]) for i, r in enumerate(rows)], "doc_id int, text string, lang string, source string")
    got = {(r.doc_id): r for r in qr.quality_rules(df, prior=10).collect()}
    assert "symbols" in got[5800].failed_rules and not got[5800].kept
    assert "symbols" not in got[5801].failed_rules


def test_repeated_windows_of_long_texts(spark):
    words = [f"w{i}" for i in range(6000)]
    again = words[:4000] + words[100:107] + words[4000:] + ["w9", "w10", "w11", "w12"]
    df = spark.createDataFrame([(1, " ".join(again)), (2, " ".join(again[:300] + again[100:106]))], "doc_id int, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert {r.doc_id: r.n_repeat_words for r in qr.quality_rules(df).collect()} == {1: 14, 2: 12}


def test_decontamination_on_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = [("b", item), ("a", "short item here"), ("c", None), (None, "w0 w1"), ("d", ""), ("a", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17")]
    docs = [
        (1, None), (2, ""), (3, item.upper()), (4, "x " * 5 + "w3-w4,w5;w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 y"), (5, " ".join(item.split()[:12])), (6, "a short Item, here b"), (7, "short item here " * 20_000),
        (8, "z " * 5000 + item + " z" * 5000), (3, item.upper()), (None, "short item here"),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id int, text string, words int")
    got = sorted((tuple(r) for r in dc.contamination(df, spark.createDataFrame(bench, "item_id string, text string")).collect()), key=str)
    want = [
        (1, 0, 0, 0, [], False), (2, 0, 0, 0, [], False), (3, 20, 20, 2, ["a", "b"], True), (3, 20, 20, 2, ["a", "b"], True), (4, 19, 13, 1, ["b"], True), (5, 12, 0, 0, [], False), (6, 5, 3, 1, ["a"], True),
        (7, 60_000, 60_000, 1, ["a"], True), (8, 10_020, 20, 2, ["a", "b"], False), (None, 3, 3, 1, ["a"], True),
    ]
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "item_id string, text string")
    assert not any(r.contaminated for r in dc.contamination(df, none).collect()) and dc.contamination(df.limit(0), none).count() == 0
    left = dc.decontaminate(df, spark.createDataFrame(bench, "item_id string, text string"))
    assert left.columns == df.columns and sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [1, 2, 5, 8]


def test_places_beyond_their_bits(spark, monkeypatch):
    monkeypatch.setattr(dc, "PLACE", 6)  # places wrap after 64 words
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "z " * 500 + item + " y" * 300 + " " + item), (2, "short " + "q " * 100)], "doc_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in dc.contamination(docs, spark.createDataFrame([("a", item), ("b", "q q")], "item_id string, text string")).collect()}
    assert got == {1: (840, 40, ["a"]), 2: (101, 100, ["b"])}


def test_redirects_carry_verdicts(spark):
    canon = '<html><link rel="canonical" href="{}"></html>'
    pages = [
        (1, "http://x.bad.net/a", None), (2, "http://mirror.org/a", canon.format("http://x.bad.net/a")), (3, "http://mirror.org/b", '<META HTTP-EQUIV="refresh" content="0; URL=http://mirror.org/a">'),
        (4, "http://ok.example.net/en/1", None), (5, "http://twin.io/1#f", canon.format("http://ok.example.net/en/1")), (6, "http://twin.io/1", canon.format("http://other.net/z")),
        (7, None, "x"), (8, "no scheme", canon.format("/p")), (9, "HTTP://WWW.Example.COM/de/x?q#r", ""), (10, "http://far.io/", canon.format("https://gone.net/y")), (10, "http://far.io/", canon.format("https://gone.net/y")),
        (11, "http://net/", None), (12, "http://net", None), (None, "http://subnet/fr/", None), (13, "http://a.org/fr/x", canon.format("http://x.bad.net/a")),
    ]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id int, url string, html string, host string")
    rules = spark.createDataFrame(list(uf.RULES), "verdict string, rule string")
    out = uf.filter_urls(df, rules)
    got = {(r.page_id, r.rule, r.verdict, r.equivalent) for r in out.collect()}
    assert got == {
        (1, "net/", "block", False), (2, None, "allow", True), (3, None, "allow", True), (4, "example.net/en/", "allow", False), (5, None, "allow", True), (6, None, "allow", True), (7, None, "allow", False),
        (8, None, "allow", False), (9, "example.com/de/", "block", False), (10, None, "block", True), (11, "net/", "block", False), (12, None, "allow", False), (None, None, "allow", False), (13, "org/fr/", "allow", False),
    }
    # without the allowed page 13 the block reaches 2 and 3 through 1
    rest = {r.page_id: r.verdict for r in uf.filter_urls(df.filter("page_id in (1, 2, 3)"), rules).collect()}
    assert rest == {1: "block", 2: "block", 3: "block"}
    assert out.count() == len(pages) and uf.filter_urls(df.limit(0), rules).count() == 0
    known = spark.createDataFrame([("http://net", "http://q.net/x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in uf.filter_urls(df.filter("page_id = 12"), rules, known).collect()} == {12: "block"}


def test_references_resolve(spark):
    base = "http://a/b/c/d;p?q"  # the examples of RFC 3986, 5.4
    want = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x",
        "": base, ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
        "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x", "HTTP://Z/../x": "HTTP://Z/x", "mailto:g": None, "javascript:void(0)": None,
    }
    df = spark.createDataFrame(list(want.items()), "to string, want string")
    assert {r.to: r.got for r in df.select("to", uf.resolve_reference(F.lit(base), F.col("to")).alias("got")).collect()} == want
    odd = spark.createDataFrame([("http://a", "g"), ("no scheme", "/p"), (None, "g"), ("https://a?x=/y/z", "g")], "base string, to string")
    assert [r[0] for r in odd.select(uf.resolve_reference(F.col("base"), F.col("to"))).collect()] == ["http://a/g", None, None, "https://a/g"]


def test_every_alias_reaches_the_block(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    blocked = [
        ("http://m1.org/p/q", link.format("//x.bad.net/a")), ("http://m2.org/p/q", refresh.format("//x.bad.net/a")), ("http://m3.org/p/q", link.format("HTTP://X.Bad.NET/a#f")),
        ("http://m4.org/p/q", link.format("http://one.org/") + '<link href="http://x.bad.net/a" rel=canonical>'), ("http://m5.org/p/q", refresh.format("http://one.org/") + refresh.format("http://x.bad.net/a")),
        ("http://m6.org/p/q", '<base href="//x.bad.net/b/">' + link.format("../a")), ("HTTP://M7.org/p/q", link.format("http://x.bad.net/a")), ("http://m7.org/p/q", None), ("http://m8.org/p/q", link.format("bad")),
    ]
    pages = [*blocked, ("http://m8.org/q", link.format("bad"))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    rules = spark.createDataFrame([("block", "x.bad.net/a"), ("block", "m8.org/p/bad")], "verdict string, rule string")
    got = {r.page_id: (r.verdict, r.equivalent) for r in uf.filter_urls(df, rules).collect()}
    assert got == dict.fromkeys(range(len(blocked)), ("block", True)) | {len(blocked): ("allow", False)}


def test_a_phrase_shorter_than_a_window_makes_no_pairs(spark, monkeypatch):
    """Four hundred items and a thousand documents share a sentence of ten words, and two of each a whole window."""
    from fluxframe.llm import decontaminate

    phrase = "which of the following best describes the main idea here"
    own = lambda kind, i: " ".join(f"{kind}{i}x{j}" for j in range(20))
    items = [(f"i{i}", f"{own('a', i)} {phrase} {own('b', i)}") for i in range(400)] + [("p", f"{phrase} and more words q"), ("q", f"{phrase} and more words q r")]
    docs = [(i, f"{own('c', i)} {phrase} {own('d', i)}") for i in range(1000)] + [(2000, f"z {phrase} and more words q r z")]
    kept, real = [], decontaminate.cut
    monkeypatch.setattr(decontaminate, "cut", lambda df: kept.append(real(df)) or kept[-1])
    found = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert {d for d, r in found.items() if r.n_hit} == {2000}
    assert (found[2000].n_hit, found[2000].items) == (15, ["p", "q"])
    for df in kept:
        if "a" in df.columns:
            assert df.count() == 3  # confirmed windows
        elif "_m" in df.columns:
            assert df.count() <= len(docs)
