"""Hostile pages: time and output grow as the page; spans; hidden elements."""

import time

import pytest

from stepwise.llm import html_text

PAGES = {
    "unfinished tag": lambda n: "<a " * n, "unfinished comment": lambda n: "<!--" * n, "comment that ends once": lambda n: "<!--" * n + "-->" + "<!--" * n, "hidden nest": lambda n: "<div hidden>" * n + "x",
    "hidden nest, closed": lambda n: "<div hidden>" * n + "</div>" * n, "marked section": lambda n: "<![CDATA[" * n + ">", "instruction": lambda n: "<?" * n, "quotes": lambda n: "<a x=\"" * n + ">",
    "one quote": lambda n: "<a x='" + "<b y=" * n + ">", "end tags": lambda n: "</a" * n, "signs": lambda n: "<" * n, "entities": lambda n: "&" * n + ";", "deep": lambda n: "<div>" * n + "x", "lists": lambda n: "<ul><li>" * n,
    "script": lambda n: "<script><" * n, "cells": lambda n: "<table>" + "<tr><td>x" * n, "wide cell": lambda n: "<table><tr><td>" + "y" * n + "<td>z" + "<tr><td>a<td>b" * n, "spans": lambda n: "<table><tr><td colspan=1000 rowspan=65534>a" + "<tr><td>b" * n,
    "span columns": lambda n: "<table>" + "<tr><td colspan=1000>a<td>b" * n, "tables": lambda n: "<table><tr><td>" * n + "x", "paragraphs": lambda n: "<p>x" * n, "p ends": lambda n: "</p>" * n,
}


@pytest.mark.parametrize("name", PAGES)
def test_time_and_output_are_linear(name):
    def run(n):
        best, out = 1e9, ""
        for _ in range(2):
            t = time.perf_counter()
            out = html_text.visible_text(PAGES[name](n))
            best = min(best, time.perf_counter() - t)
        return best, len(out)

    n = 4000
    (a, _), (b, size) = run(n), run(4 * n)
    assert b < 4 * 1.9 * a + 0.05, (a, b)
    assert size <= 300 * len(PAGES[name](4 * n)) + 10_000


def test_unfinished_text_is_kept():
    assert html_text.visible_text("a <!-- b <i>c</i>") == "a <!-- b c"
    assert html_text.visible_text("x<!-- no -->y<!-- z") == "xy<!-- z"
    assert html_text.visible_text("a < b <c") == "a < b <c"


def test_spans_keep_columns():
    page = "<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td colspan=2>wide<td>d</table>"
    assert html_text.visible_text(page) == "A    | b\n     | c\nwide |   | d"
    far = "<table><tr><td colspan=60>a<td>b<tr>" + "<td>x" * 60 + "<td>y</table>"
    first, second = html_text.visible_text(far).split("\n")
    assert first.index("b") == second.index("y")


def test_hidden_elements_end_where_they_should():
    assert html_text.visible_text("<div hidden>a<div>b</div>c</div>d") == "d"
    assert html_text.visible_text("<ul><li hidden>a<ul><li>x</ul>b<li>c</ul>d") == "- c\nd" or html_text.visible_text("<ul><li hidden>a<ul><li>x</ul>b<li>c</ul>d").startswith("- c")
    assert html_text.visible_text("<table><tr><td hidden>a<b>q<td>b<tr><td>c</table>") == "b\nc"
    assert html_text.visible_text("<p hidden>a<span>b<p>c") == "c"
    assert html_text.visible_text("<section><div hidden><p>a</section>b") == "b"
    assert html_text.visible_text("<head><title>t</title><div>x</div>") == "x"
