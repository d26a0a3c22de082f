"""Rendered text of small pages, and that no visible text is lost."""

import html
import random
import re

import pytest
from helpers import awkward

from motionlake.llm import html_text as H

CASES = [
    ("", ""),
    ("plain &amp; text &lt;b&gt;", "plain & text <b>"),
    ("<p>One<p>Two <b>bold<p>three</b> end", "One\n\nTwo bold\n\nthree end"),
    ("a  b\n c<br>d<br><br>e", "a b c\nd\n\ne"),
    ("<div>a</div><div>b<span> c </span> d</div>", "a\nb c d"),
    ("<h1>H</h1><div>x</div>y", "H\n\nx\ny"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>tail", "- a\n- b\n  - c\n\ntail"),
    ("<ol start=9><li>x<br>y<li>z<li value=3>w</ol>", "9. x\n   y\n10. z\n3. w"),
    ("<ol type=a><li>x<li>y</ol><ol reversed type=I><li>p<li>q</ol>", "a. x\nb. y\n\nII. p\nI. q"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<pre>\n a\n\n  b &lt; c</pre>", " a\n\n  b < c"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Banana<td>10</table>", "Name    Qty\nApple   3\nBanana  10"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
    ("<table><caption>Cap</caption><tr><td>漢字<td>x<tr><td>abc<td>y</table>", "Cap\n漢字  x\nabc   y"),
    ("<table><tr><td>a<p>b<td>c</table>", "a  c\n\nb"),
    ("<table>stray<tr><td>cell</table>", "stray\n\ncell"),
    ("<table><td>a<tr><td>b</table>c", "a\nb\n\nc"),
    ("<title>T</title>shown<script>var a='</p>';</script><style>p{}</style><noscript>ns</noscript>", "shownns"),
    ("<div hidden>no</div><p style='display: none'>no</p><input type=hidden value=no>yes<input value=in>", "yesin"),
    ("<style>.h, #i {display:none} p .x {display:none}</style><div class='a h'>no</div><b id=i>no</b><p><i class=x>yes</i>", "yes"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<select><option>1<option selected>2</select><textarea>\nx</textarea>", "2 x"),
    ("<a href='x>y' title=\"<p>\">l</a><!-- no --><!doctype html><?php no ?>m", "lm"),
    ("text<div <b>after", "text\nafter"),
    ("kept<a href='never closed", "kept"),
    ("<b>x<div>y</b>z</div>w", "x\nyz\nw"),
    ("<body><p>a</body></html>b", "ab"),
    ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby><q>s</q>", 'kr"s"'),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    assert H.text_of(page)[0] == text


def plain_page(rnd):
    """A random well-formed page and its text, laid out by rules of its own: (lines, has margins) for each block."""
    word = lambda: rnd.choice(["alpha", "be", "gamma", "d", "épsilon", "zeta9"])
    words = lambda: " ".join(word() for _ in range(rnd.randint(1, 6)))

    def inline():
        shown, source = [], []
        for _ in range(rnd.randint(1, 3)):
            w = words()
            tag = rnd.choice(["b", "span", "i", ""])
            shown.append(w)
            source.append(f"<{tag}>{w}</{tag}>" if tag else w)
        return " ".join(source), " ".join(shown)

    def block(depth):
        kind = rnd.choice(["p", "div", "h2", "ul", "ol", "table", "section" if depth else "p"])
        if kind in ("p", "div", "h2"):
            source, shown = inline()
            return f"<{kind}>{source}</{kind}>", [shown], kind != "div"
        if kind in ("ul", "ol"):
            items = [inline() for _ in range(rnd.randint(1, 4))]
            lines = [f"{'-' if kind == 'ul' else f'{i + 1}.'} {shown}" for i, (_, shown) in enumerate(items)]
            return f"<{kind}>" + "".join(f"<li>{source}</li>" for source, _ in items) + f"</{kind}>", lines, True
        if kind == "table":
            n = rnd.randint(1, 4)
            rows = [[words() for _ in range(n)] for _ in range(rnd.randint(1, 4))]
            width = [max(len(r[k]) for r in rows) for k in range(n)]
            lines = ["  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows]
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>", lines, True
        source, lines = [], []
        for k, (s, part, margin) in enumerate(parts := [block(0) for _ in range(rnd.randint(1, 3))]):
            source.append(s)
            lines += [""] * bool(k and (margin or parts[k - 1][2])) + part
        first, last = parts[0][2], parts[-1][2]
        return f"<section>{''.join(source)}</section>", lines, (first, last)

    source, lines, before = [], [], False
    for k in range(rnd.randint(1, 7)):
        s, part, margin = block(1)
        first, last = margin if isinstance(margin, tuple) else (margin, margin)
        source.append(s)
        lines += [""] * bool(k and (before or first)) + part
        before = last
    return "\n".join(source), "\n".join(lines)


def test_well_formed_pages_are_laid_out_by_plain_rules():
    rnd = random.Random(12)
    for _ in range(400):
        page, text = plain_page(rnd)
        assert H.text_of(page)[0] == text, page


@pytest.mark.parametrize("seed", range(5))
def test_no_text_is_lost_in_any_soup(seed):
    rnd = random.Random(seed)
    tags = "p div b i a span ul ol li table tr td th tbody h1 h2 pre blockquote section dl dt dd center form button label em".split()
    for _ in range(150):
        words, parts = [], []
        for k in range(rnd.randint(1, 80)):
            if rnd.random() < 0.4:
                words.append(f"w{k}x")
                parts.append(html.escape(f" {words[-1]} "))
            else:
                parts.append(f"<{'/' * (rnd.random() < 0.4)}{rnd.choice(tags)}>")
        found = re.findall(r"w\d+x", H.text_of("".join(parts))[0])
        assert sorted(found) == sorted(words), "".join(parts)


def test_deep_pages_keep_their_text():
    for part in ("<div>x", "<ul><li>x", "<table><tr><td>x", "<b>x", "<table>x"):
        assert H.text_of(part * 3000)[0].count("x") == 3000


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "text AS html", "doc_id AS page_id", "1 AS n_lines")
    rows = {r.page_id: r for r in H.extract(docs).collect()}
    assert (rows[1].text, rows[2].text, rows[1].n_lines) == ("", "", 0)
    assert rows[4].text == ("word " * 60_000).strip() and rows[5].text == "the same row twice with two lines"
    assert H.extract(docs).count() == 8 and H.extract(docs.limit(0)).count() == 0
