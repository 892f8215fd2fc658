"""HTML extraction: whole tables against a plain reading of their markup, and layouts made by hand."""

from __future__ import annotations

import html as entities
import random
import re

import pytest

from newslake.llm import page_slots, queries

WORDS = [a + b for a in "ka lo mi nu pe ri so tu va wo".split() for b in "ran sel tik mon dar".split()]


def plain_article(page: str) -> str:
    """The article of a page of the tables, whose markup has no other elements than these."""
    inside = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\0", inside)).split("\0")
    return " ".join(" ".join(entities.unescape(x).split()) for x in parts if x.strip())


def test_query_equals_plain_reading(spark, sf_dir):
    rows = queries.QUERIES["op12_page_slots"](spark, sf_dir).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain_article(pages[r["page_id"]]["html"])
        assert (r["n_chars"], r["url"]) == (len(r["text"]), pages[r["page_id"]]["url"])


def prose(seed: object, n: int = 40) -> str:
    rng = random.Random(str(seed))
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def extract(spark, rows, schema="page_id long, url string, html string"):
    found = page_slots.extract_pages(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    return {r["page_id"]: r["text"] for r in found.collect()}


LAYOUTS = {
    "no article element": lambda i, a, b, c: f"""<body><div id="top"><a href="/">Home</a> <a href="/n">News</a></div>
      <div id="col"><h1>Story {i}</h1><p>{a}</p><p>Call us today at our office.</p><p>{b}</p></div>
      <div id="right"><p><a href="/{i}">{c[:60]}</a></p><p><a href="/x{i}">{c[60:120]}</a></p></div>
      <div class="user-comments"><p>{c}</p></div><form><p>{c}</p></form></body>""",
    "main element": lambda i, a, b, c: f"""<body><header><h2>{c}</h2></header><main class="has-sidebar"><h1>Story {i}</h1>
      <p>{a}<p>{b}<aside><p>{c}</aside><section class="comments"><article><p>{c}</p></article></section></main>
      <footer><p>{c}</footer>""",
    "declared by class": lambda i, a, b, c: f"""<div class="wrapper"><div class="sidebar"><p>{c} {c}</p></div>
      <div class="post-{i} entry-content"><h1>Story {i}</h1><p>{a}</p><p>{b}</p></div>
      <div role="complementary"><p>{c}</p></div><div class="cookie-notice">{c}</div></div>""",
}


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("n", [1, 30])
def test_layouts(spark, name, n):
    rows = [
        (i, f"http://h.example/{i}", LAYOUTS[name](i, prose(("a", i)), prose(("b", i)), prose(("c", i), 30))) for i in range(n)
    ]
    got = extract(spark, rows)
    for i in range(n):
        fixed = "Call us today at our office. " if name == "no article element" and n == 1 else ""
        assert got[i] == f"Story {i} {prose(('a', i))} {fixed}{prose(('b', i))}"


def test_fixed_blocks_go_only_with_enough_pages(spark):
    page = lambda i: f"<article><h1>T{i}</h1><p>{prose(i)}</p><p>Never miss any news again.</p></article>"
    rows = [(i, f"http://{'big' if i < 20 else 'small'}.example/{i}", page(i)) for i in range(23)]
    got = extract(spark, rows)
    assert all(("Never miss" in got[i]) == (i >= 20) for i in range(23))


def test_copies_of_an_article_keep_its_text(spark):
    """Nine in thirty pages have the same text: no template."""
    rows = [(i, f"http://h.example/{i}", f"<nav>x</nav><article><p>{prose(i % 9 if i < 18 else i)}</p></article>") for i in range(30)]
    got = extract(spark, rows)
    assert all(got[i] == prose(i % 9 if i < 18 else i) for i in range(30))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("   \n ", ""), 4: ("plain <b>te</b>xt &amp; more", "plain text & more"),
        5: ("<p>a&nbsp;&#98;\n c<br>d<script>if (a<b) '</p>'</script><p>e<!-- f --> g", "a b c d e g"),
        6: (f"<article><p>{long}</p></article>", long), 7: ("<p>unfinished <a href='x", "unfinished"),
        8: ("<ul><li>one<li>two</ul></div></p>3 < 4 > 2", "one two 3 < 4 > 2"), 9: ("<p>x<!-- never closed <p>y", "x"),
        10: ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), 11: ("<p title=\"a>b\" class=x\">q</p>r", "q r"),
        12: ("<body><p>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), 13: ("<title>no</title><p hidden>h</p>s", "s"),
    }
    rows = [(i, url, page, "host", 1.5) for i, (page, _) in cases.items() for url in (None, f"http://H{i}.example/")]
    rows += rows[:8] + [(None, None, None, None, None), (1 << 62, "x", "<p>y", None, None)]
    found = page_slots.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string, text double"))
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == {None: "", 1 << 62: "y"}.get(r["page_id"], cases.get(r["page_id"], ("", ""))[1])
    assert found.where("false").count() == 0
    assert extract(spark, []) == {}
