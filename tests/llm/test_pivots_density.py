import html as entities
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from blockmill.llm import pivots, queries
from blockmill.llm.density import main_text, main_texts
from tests.helpers import DATA


def brute(rows, k):
    """[(query, rank, id, score)] over (id, vector) rows"""
    out = []
    for q in sorted({i for i, _ in rows if i % 3 == 0}):
        vector = min(v for i, v in rows if i == q)
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in rows if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("part_rows", [32_768, 5])
def test_search_is_exact(spark, part_rows, monkeypatch):
    monkeypatch.setattr(pivots, "RING_ROWS", part_rows)
    monkeypatch.setattr(pivots, "QUERY_ROWS", part_rows)
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-3, 3) + (i % 4) * 20) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [5.0] * 6) for i in range(30)] + [(9, [1.0] * 6), (300, [0.0] * 6), (301, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, (302, None), (303, [1.0, None]), (None, [1.0])], "vec_id long, vector array<double>")
    got = pivots.top_products(df, F.col("vec_id") % 3 == 0, k=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0])], "vec_id long, vector array<double>")
    got = sorted(map(tuple, pivots.top_products(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 100, 2), (100, 1, 0, 2)]
    assert pivots.top_products(df.limit(0), F.lit(True)).count() == 0
    nan = spark.createDataFrame([([float("nan")],), ([float("inf")],), ([None],), (None,), ([-0.0005],)], "e array<float>")
    assert [r[0] for r in nan.select(pivots.quantised(F.col("e"))).collect()] == [None, None, None, None, [-1.0]]


def test_pages_of_the_table(spark):
    """The given pages mark their text with one element; nothing else of them counts."""
    pages = duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall()
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op9_text_density(spark, DATA).collect()}
    assert len(got) == len(pages)
    for page, html in pages:
        body = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>|<br>", body))
        want = "\n".join(p for p in parts if p)
        assert got[page] == (want, len(want))


LONG = "One sentence of the story that goes on for a while, and then some more of it. "


def test_without_article_element():
    page = f"""<html><body><header><h1>Site</h1></header><div class='menu'><a href=/>Home</a></div>
    <div id=wrap><div class=story><h2>Head &amp; line</h2><p>{LONG * 3}</p><p>{LONG}<b>bold\n</b>\n<i>x</i> y<p>Short one.</div>
    <div><ul><li><a href=1>Other story</a><li><a href=2>More stories</a></ul></div>
    <div class="user-comments"><p>{LONG * 5}</p></div><div id=cookieNotice>We use cookies</div></div>
    <form><p>{LONG}</form><script>var a = "<p>no</p>"</script><footer>&copy; me</footer></body></html>"""
    want = ["Head & line", (LONG * 3).strip(), LONG + "bold x y", "Short one."]
    assert main_text(page).split("\n") == want


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &lt;text&gt;  here", "plain <text> here"), ("<div><p>a<p>b</div></p>c", "a\nb\nc"),
        ("<article>A<br>b<!-- no --><table><tr><td>1<td>2</table><aside>x</aside></article>", "A b\n1 2"),
        ("<div class='page has-sidebar no-menu'><p>a<p>b</div><div class='side sidebar'>c</div>", "a\nb"),
        ("<nav>only a menu</nav>", ""), ("text<div class=", "text"), ("<article><div>" * 3000 + "deep", "deep"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_column(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "<p>x</p>", "t")], "page_id long, html string, text string")
    assert [r[0] for r in df.select(main_texts("html")).collect()] == ["", "x"]
    assert df.limit(0).select(main_texts("html")).count() == 0


STORY = LONG * 6


@pytest.mark.parametrize("page", [
    "<head><title>x</title><body><div>{}</div></body>",
    "<ul><li class='share'>s<li>y</ul><div>{}</div>",
    "<p class='notice'>we use<div>{}</div>",
    "<section><div class='advert'>buy</section><div>{}</div>",
    "<table><tr class='menu'><td>m<tr><td>{}</table>",
    "<article class='comment'>I think so too.</article><div>{}</div>",
    "<div class='social-science-story'>{}</div>",
])
def test_dropped_elements_end_where_html_ends_them(page):
    text = main_text(page.format(STORY))
    assert STORY.strip() in text and "buy" not in text and "we use" not in text and "think" not in text


def test_a_teaser_is_not_the_story():
    text = main_text(f"<div>{STORY}</div><article class='card'>Teaser</article>")
    assert STORY.strip() in text
    both = main_text(f"<article><p>{STORY}</p><p>End.</p></article><div>Short.</div>")
    assert both == f"{STORY.strip()}\nEnd."
