"""Visibility, depth and width of rendered pages, and listed sites behind other spellings of their URL."""

import time

import pytest
from pyspark.sql import functions as F

from chorus.llm import html, urlfilter


@pytest.mark.parametrize("page,text", [
    ('<p style="backface-visibility:hidden">seen</p>', "seen"), ('<p style="visibility:inherit">seen</p>', "seen"), ('<p style="content-visibility:auto">seen</p>', "seen"),
    ('<p style="content-visibility:hidden">x</p>', ""), ('<p style="VISIBILITY : Hidden">x<b style="visibility:visible">y</b></p>', "y"), ('<p style="display: none !important">x</p>', ""),
    ('<p style="display:none;display:block">seen</p>', "seen"), ('<p style="display:none!important;display:block">x</p>', ""), ("<p style='/* display:none */color:red'>seen</p>", "seen"),
    ("<math><mi>a</mi><annotation>b</annotation></math>", "a"), ("<svg><title>t</title><desc>d</desc><text>seen</text></svg>", "seen"), ("<xmp>a <b> &amp;</xmp>", "a <b> &amp;"),
    ('<input value="seen">', "seen"), ('<input type="hidden" value="x"><input type=Search value="y">', "y"), ('<input type="password" value="x">', "")])
def test_what_is_visible(page, text):
    assert html.visible_text(page) == text


def test_deep_lists_take_time_in_proportion():
    sizes, times = [], []
    for depth in (2000, 8000):
        began = time.perf_counter()
        text = html.visible_text("<ul><li>x" * depth)
        times.append(time.perf_counter() - began)
        assert text.count("x") == depth
        sizes.append(len(text))
    assert sizes[1] < 5 * sizes[0] and times[1] < 12 * max(times[0], 0.05)
    assert html.visible_text("<ul><li>a<ul><li>b</ul></ul>") == "- a\n  - b"


def test_wide_tables_stay_aligned():
    row = lambda x: "<tr>" + "".join(f"<td>{x}{k % 3}" for k in range(1500))
    first, second = html.visible_text(f"<table>{row('a')}{row('bbb')}</table>").split("\n")
    assert len(first.split()) == len(second.split()) == 1500
    assert [k for k in range(len(first)) if first[k] == "a"] == [k for k in range(0, len(second), 6)]


def test_clashing_names_of_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a b", "own")], "page_id long, html string, text string")
    got = html.extracted(pages, keep=("page_id", "text"))
    assert got.columns == ["page_id", "text", "text_", "n_lines", "n_words"] and tuple(got.first()) == (1, "own", "a b", 1, 2)


@pytest.mark.parametrize("url,verdict", [("http://casino-win.example.com", "block"), ("http://casino-win.example.com?q=1", "block"), ("http://casino-win.example.com/", "block"),
                                         ("http://user:pw@Casino-Win.example.com:8080/a", "block"), ("http://www.casino-win.example.com./#x", "block"), ("http://casino-win.example.com.evil.io/", "allow"),
                                         ("http://a@b@casino-win.example.com:", "block"), ("http://", "allow"), ("casino-win.example.com/", "allow"), (None, "allow"), ("http://:80/", "allow")])
def test_listed_sites_in_other_spellings(spark, url, verdict):
    row = urlfilter.judged(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert row.verdict == verdict and row.rule is None


def test_rules_meet_the_url_as_written(spark):
    rows = urlfilter.judged(spark.createDataFrame([(1, "http://x.net"), (2, "http://x.net/"), (3, "http://x.net:80/")], "page_id long, url string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows.collect()}
    assert got == {1: ("x.net", "", None, "allow"), 2: ("x.net", "/", "net/", "block"), 3: ("x.net:80", "/", None, "allow")}
    assert rows.where(F.col("page_id") < 0).collect() == []
