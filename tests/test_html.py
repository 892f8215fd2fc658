from __future__ import annotations

import pytest
from newslake.functions.html import cut_boilerplate, with_boilerplate_cut, with_markdown, with_page_title


def markdown(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i INT, page STRING")
    return [r["md"] for r in with_markdown(rows, "page", "md").orderBy("i").collect()]


def test_heading_and_bold(spark):
    (md,) = markdown(spark, "<article><h1>Title</h1><p>Some <b>bold</b>.</p></article>")
    assert md == "# Title\n\nSome **bold**."


def test_noise_is_gone_and_content_stays(spark):
    page = """<html><head><title>Blog</title><script>track("</p>");</script></head><body>
      <nav>Home | About</nav><div class="big cookie-banner">Accept <div>our</div> cookies</div>
      <article><h1>Release</h1><p>It changes much.</p></article>
      <footer>(c) notices</footer></body></html>"""
    (md,) = markdown(spark, page)
    assert md == "# Release\n\nIt changes much."


def test_regular_and_odd_pages_agree(spark):
    plain = "<body><nav>a</nav><p>text</p><footer>b</footer></body>"
    odd = "<body><nav>a<nav>x</nav></nav><p>text</p><p id='advert'>y</p><footer>b</body>"
    assert markdown(spark, plain, odd) == ["text", "text"]


@pytest.mark.parametrize(
    ("page", "left"),
    [
        ("<div><nav>a<nav>b</nav>c</nav>d</div>", "<div>d</div>"),
        ("<div><nav>a</div>b", "<div></div>b"),
        ("a<aside>b", "a"),
        ('<p class="cookie">a<p>b', "<p>b"),
        ('x<img class="advert">y', "xy"),
        ('<div id="xadverty"><p>a</div>b', "b"),
        ("a</nav>b", "ab"),
        ('<div class="Cookie">a</div>', '<div class="Cookie">a</div>'),
        ("<head><title>t<body>b", "<body>b"),
        ("<ul><li class=cookie>a<li>b</ul>", "<ul><li>b</ul>"),
        (None, None),
    ],
)
def test_cut_boilerplate(page, left):
    assert cut_boilerplate(page) == left


def test_cut_reaches_marked_subtrees_in_spark(spark):
    pages = spark.createDataFrame([('<p>a</p><div class="advert"><div>b</div>c</div>d',), (None,)], "page STRING")
    got = [r["o"] for r in with_boilerplate_cut(pages, "page", "o").collect()]
    assert got == ["<p>a</p>d", None]


def test_markdown_forms(spark):
    got = markdown(
        spark,
        '<p>See <a class="x" href="https://e.org/a_b">this  <i>one</i></a><br>next</p>',
        "<ul><li>one</li><li>two</li></ul><hr><blockquote><p>said</p></blockquote>",
        "5 * 3_4 &lt;b&gt; &amp;amp; &eacute;&#33;",
        "<table><tr><td>a</td><td>b</td></tr></table><img src='x'><code>y</code>",
        "plain\n\n text   here",
        '<a title="a*b">l</a>',
        "<p>a</p>\n\n\n<p>b</p>",
        "<H2>Up</H2>low",
    )
    assert got == [
        "See [this *one*](https://e.org/a_b)  \nnext",
        "* one\n* two\n\n---\n\n> said",
        "5 \\* 3\\_4 <b> &amp; é!",
        "a  b\n\n`y`",
        "plain\ntext here",
        "l",
        "a\n\nb",
        "## Up\n\nlow",
    ]


def test_titles(spark):
    pages = [
        "<title>T</title><h1> A <b>b</b> </h1><h1>C</h1>",
        "<title> T &amp; U</title>",
        "<p>none</p>",
        "<H1 class='x'>R&amp;D &eacute;&amp</H1>",
        "<!--<h1>no</h1>--><script>'<h1>x</h1>'</script><h1></h1>",
    ]
    rows = spark.createDataFrame([(i, p, "u") for i, p in enumerate(pages)], "i INT, page STRING, url STRING")
    got = [r["title"] for r in with_page_title(rows, "page", "url", "title").orderBy("i").collect()]
    assert got == ["Ab", "T & U", "u", "R&D é&", ""]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p><b>bold <i>both</i></b> x</p>", "**bold *both*** x"),
        ("<b><a href='u'>l</a></b>", "**[l](u)**"),
        ("<p><b> spaced <i>out</i> </b>x", " **spaced *out*** x".strip()),
        ("<p><b>open <i>both<p>next <i>a <b>b</b></i>", "open both\n\nnext *a **b***"),
        ("<ol><li>a<li>b<ol><li>c</ol><li>d</ol>", "1. a\n2. b\n   1. c\n3. d"),
        ("<ul><li>a<ol start='7'><li>b</li></ol></li></ul>", "* a\n  7. b"),
        ("<pre>\n  x *y*\n\n\n  &lt;z&gt;\n</pre>after", "```\n  x *y*\n\n\n  <z>\n\n```\n\nafter"),
        ("<pre>never closed", "```\nnever closed\n```"),
        ("<table><tr><th>a<th>b<tr><td>1</table>t", "| a | b |\n| --- | --- |\n| 1 |  |\n\nt"),
        ("<table><th>only</table>", "| only |\n| --- |"),
        ("<ol></ol>5 * 3<br>b", "5 \\* 3  \nb"),
        ("<ol><li></ol></ol></table></b>", "1."),
    ],
)
def test_nested_marks(spark, page, want):
    assert markdown(spark, page) == [want]
