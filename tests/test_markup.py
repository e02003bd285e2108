"""Markup of any size and shape: linear scanning of anchors, frames and lines, and the charset of pages."""

import time

import pytest
from pyspark.sql import functions as F

from vacantia.functions import markup as M, text as T
from vacantia.operators import pages as P
from vacantia.sources import capture as CAP

BIG = "x" * 100_000


def links(spark, html):
    df = spark.createDataFrame([(1, html, "https://h.example/p")], "id long, html string, base string")
    return [(r.pos, r.href, r.label, r.resolved) for r in P.extract_links(df, "html", "base").collect()]


@pytest.mark.parametrize("html, want", [
    ('<a class=j href="/jobs/1">One <b>two</b></a>', [("/jobs/1", "One two")]),
    ("<A HREF=/jobs/2 >x</A >", [("/jobs/2", "x")]),
    ("<a href='/a?b=1&amp;c=2'>&lt;x&gt; &amp;amp;</a>", [("/a?b=1&c=2", "<x> &amp;")]),
    ('<a data-href="/no" href="/yes">x</a>', [("/yes", "x")]),
    ('<a data-href="/no">x</a><abbr href="/no">y</abbr>', []),
    ('<a title="a > b" href="/1">x</a>', [("/1", "x")]),
    ('<a title=it\'s href="/1">x</a>', [("/1", "x")]),
    ('<a title="<a href=\'/no\'>" href="/1">x</a>', [("/1", "x")]),
    ('<a href="/1"><img alt="</a>" src=x>y</a>', [("/1", "y")]),
    ('<a href="/1">x<a href="/2">y</a>', [("/2", "y")]),
    ('<a href="/1">x', []), ('<a href="/1"', []), ("", []), (None, []),
    ('<!-- <a href="/no">x</a> --><a href="/1">y<!-- </a> -->z</a>', [("/1", "yz")]),
    ('<script>"<a href=/no>x</a>"</script><a href=/1>y</a>', [("/1", "y")]),
    ('<a href="">x</a><a href>y</a>', [("", "x")]),
    ('<a\nclass="k"\n  href = "/1"\n>x</a>', [("/1", "x")]),
    ('<a/href="/1">x</a>', [("/1", "x")]),
])
def test_anchors(spark, html, want):
    assert [(h, label) for _, h, label, _ in links(spark, html)] == want


@pytest.mark.parametrize("html, n", [
    (f'<a class={BIG} href="/jobs/1001">One</a>', 1), (f'<a class="{BIG}>" href="/jobs/1001">One</a>', 1),
    ("<a " + "k=v " * 50_000 + "href=/jobs/1001>One</a>", 1), (f"<a href=/jobs/1001>{BIG}</a>", 1), (f"<a href='/{BIG}'>One</a>", 1),
    ("<a " * 100_000, 0), ("<a href=/x>" * 50_000, 0), ('<a title="' * 50_000, 0), ("<!-- " * 100_000, 0), ("<script>" * 50_000, 0),
    ("<nav>" * 100_000, 0), ("<" * 500_000, 0), ("<a " + "=" * 200_000 + ">", 0), ("<a href='" * 50_000 + "x", 0),
    (f"<iframe class={BIG} src=https://f.example/w></iframe>", 0)])
def test_long_and_broken_markup(spark, html, n):
    df = spark.createDataFrame([(1, html, "https://h.example/p")], "id long, html string, base string")
    start = time.time()
    assert len(links(spark, html)) == n
    frames = P.embedded_sources(df, "html", "base").collect()
    assert len(frames) == html.startswith("<iframe") and df.select(F.size(T.html_lines("html")).alias("n")).first().n >= 0
    assert time.time() - start < 60


def test_attributes(spark):
    one = lambda html, name: spark.createDataFrame([(html,)], "h string").select(M.attribute("h", name).alias("v")).first().v
    assert one('<img alt=\'a "b"\' src="x y" src=z>', "src") == "x y" and one("<i SRC=q>", "src") == "q" and one('<i src="open>', "src") == '"open'
    assert one("<i data-src=a>", "src") is None and one("<i src>", "src") is None and one('<i src="">', "src") == ""
    assert one("<i a=1/src=2>", "src") is None and one('<i a="1"src=2>', "src") is None and one("<i a='x' src='2'/>", "src") == "2"


def test_lines(spark):
    one = lambda html: spark.createDataFrame([(html,)], "h string").select(T.html_lines("h").alias("v")).first().v
    assert one("<p>a<b>b</b></p>c<br>d &amp; e<script>if (a<b) '<!--'</script>f") == ["ab", "c", "d & e", "f"]
    assert one('<div title="x > y">a</div><p-x>b</p-x>') == ["a", "b"] and one("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]
    assert one("a<!-- x -->b<header>h<nav>n</nav></header>c<svg>d") == ["ab", "c"] and one("a&#1;b") == ["a\x01b"]


def test_charset_of_pages(spark, tmp_path):
    text = "<html><head>%s<title>Stelle 岗位</title></head></html>"
    latin = "<html><head>%s<title>Stelle für Köche</title></head></html>"
    cases = [((text % "").encode(), None, text % ""), (("﻿" + text % "").encode(), "text/html", text % ""),
             ((latin % '<meta charset="iso-8859-1">').encode("latin-1"), None, latin % '<meta charset="iso-8859-1">'),
             ((text % '<META http-equiv=x content="text/html; charset=gbk">').encode("gbk"), "text/html", text % '<META http-equiv=x content="text/html; charset=gbk">'),
             ((latin % '<meta charset="utf-8">').encode("latin-1"), "text/html; charset=latin1", latin % '<meta charset="utf-8">'),
             ((text % "").encode("gb18030"), None, text % ""), (b"", None, ""), (None, None, None)]
    df = spark.createDataFrame([(i, c, k) for i, (c, k, _) in enumerate(cases)], "id long, content binary, kind string")
    got = {r.id: r.html for r in CAP.page_texts(df, "content", "kind").collect()}
    # the bytes of a meta charset that do not fit fall through to the next
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}
    for i in (0, 2, 3):
        (tmp_path / f"{i}.html").write_bytes(cases[i][0])
    pages = {r.url.rsplit("/", 1)[1]: r.html for r in CAP.read_pages(spark, str(tmp_path), "binaryFile").collect()}
    assert pages == {f"{i}.html": cases[i][2] for i in (0, 2, 3)}
