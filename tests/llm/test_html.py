import time

import pytest

from firnline.llm import html


def text(page):
    return html.render(html.parse(page))


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>x</b><i>y</i> z", "xy z"), ("<h1>T</h1>text", "T\n\ntext"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<pre> x\n  y </pre>", " x\n  y"), ("a &amp; b &lt;c&gt;", "a & b <c>"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<script>var t='<p>no</p>';</script>yes", "yes"), ("<style>p{}</style><p hidden>no<p>yes", "yes"),
    ("<div style='color:red; display : none'>no</div>yes", "yes"), ("<title>no</title><body>yes", "yes"), ("<!-- no -->yes<!-- open", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<table><tr><td>a<td>long cell<tr><td>longer<td>b</table>", "a       long cell\nlonger  b"),
    ("<table><tr><th colspan=2>head<tr><td>a<td>b</table>", "head\na  b"),
    ("<table><tr><td>x<table><tr><td>in</table><td>y</table>", "x   y\n\nin"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"), ("</p></div>x</table>", "x"), ("<p title='a > b'>x", "x"), ("<img alt=pic>", "pic"),
    ("<dl><dt>a<dd>b</dl>", "a\n  b"), ("x<span hidden>y</span>z", "xz"),
])
def test_rendering(page, want):
    assert text(page) == want


def test_no_visible_text_is_lost():
    words = [f"w{i}" for i in range(400)]
    tags = ["<p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<br>", "</p>", "<h2>", "</h2>", "<dd>", "<span>", "<th>"]
    page = "".join(w + " " + tags[(i * 7 + i // 5) % len(tags)] for i, w in enumerate(words))
    assert sorted(text(page).split()) == sorted(words + ["-"] * text(page).split().count("-"))


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "x") == "x"
    assert text("<table><tr>" + "<td>c" * 300).split() == ["c"] * 300
    assert text("<td>a</td>").strip() == "a" and text("<" * 5000).startswith("<")


@pytest.mark.parametrize("page,want", [
    ("<p>x = <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>tex</annotation></math></p>", "x = a+b"),
    ("<svg><title>no</title><defs/><path d='M0'/><text>Label</text><text>two</text></svg><object>fallback</object>", "Label twofallback"),
    ("a<svg><defs><text>no</text></defs></svg>b", "ab"), ("<object data=x><p>shown</p></object>", "shown"),
])
def test_formulas_drawings_and_objects_are_text(page, want):
    assert text(page) == want


HOSTILE = {
    "open tags": "<a ", "nested blocks": "<div>x ", "stops": "<p><button>" + "<span>" * 400 + "<div>y ", "quotes": "<a \"b' ", "lists": "<ul><li>x", "tables": "<table><tr><td>x",
    "cells": "<td>c", "closing": "</div></p>", "comments": "<!-", "spans": "<td colspan=1000>c", "self": "<svg><g/>", "entities": "&amp",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_of_a_megabyte_take_seconds(kind):
    unit = HOSTILE[kind]
    began = time.process_time()
    got = text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 15
    if kind in ("nested blocks", "lists", "tables"):
        assert got.count("x") == 1_000_000 // len(unit)


def test_one_tall_cell_beside_many():
    began = time.process_time()
    got = text("<table><tr>" + "<td>c" * 100_000 + "<td>" + "t<br>" * 100_000)
    assert time.process_time() - began < 15 and got.count("c") == got.count("t") == 100_000


def test_rows(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>b", "t"), (2, "u", None, "t"), (3, "u", "", "t"), (None, "u", "<td", "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "<td"), (1, "a"), (1, "b"), (2, ""), (3, "")]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
