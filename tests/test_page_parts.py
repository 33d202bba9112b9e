"""Images, dates, options and long texts of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import page_parts, trees
from loomline.sources import dom

SHOP = """<body><header><img src=/logo.png></header><div class="product-gallery"><img src="/a.jpg?w=100" width=80 alt="A"><img srcset="/a.jpg?w=800 800w, /a.jpg?w=400 400w" alt="A"><img data-src="/b.jpg" src="data:image/gif;base64,R0"></div>
<a href="/p/2"><img src="/other.jpg" alt="Other" width=500></a><img src="https://t.com/pixel.gif"><div class=related><img src=/r.jpg></div>
<label for=sz>Size:</label><select id=sz name=attribute_x><option>Choose an option<option value=s>S<option selected>M<option disabled>L<option>XL - Sold out</select>
<select aria-label="Select Color"><option value="#fff">#fff<option>Red<option>Blue<option>Red</select><input type=radio name="material" value="wool" id=w checked><label for=w>Merino wool</label><input type=radio name=material value=cotton class=sold-out>"""
BLOG = """<body><meta property="article:published_time" content="2024-02-03"><time datetime="">old</time><div class=list><article class=post><h2><a href=/1>First entry</a></h2><time datetime="2024-01-01">Jan</time><p>First entry</p><p>The story of the first entry, told.</p></article>
<article class=post><h2><a href=/2>Second entry</a></h2><time datetime="2024-01-02">Jan</time><p>short</p><p>The story of the second one, told.</p></article></div><p>A paragraph that no card holds at all.</p>"""


def tree(spark, *pages):
    return dom.nodes(spark.createDataFrame(list(enumerate(pages, 1)), "page_id long, html string"))


def test_images(spark):
    nodes = tree(spark, SHOP, None)
    urls = spark.createDataFrame([(1, "https://s.com/x"), (2, "u")], "page_id long, page_url string")
    got = [(r["url"], r["score"]) for r in page_parts.images(nodes, urls).orderBy("place").collect()]
    assert got == [("https://s.com/a.jpg?w=800", 6), ("https://s.com/b.jpg", 4), ("https://s.com/other.jpg", 3)]
    assert [r["place"] for r in page_parts.images(nodes, urls, most=1, unlinked=True).collect()] == [1]


def test_dates_and_cards(spark):
    nodes = tree(spark, BLOG, "<p>none</p>")
    assert [tuple(r) for r in page_parts.publication_date(nodes).collect()] == [(1, "2024-01-01")]
    cards = trees.cards(nodes).where("signature LIKE 'article%'")
    got = [(r["title"], r["date"], r["summary"]) for r in page_parts.card_details(nodes, cards).orderBy("place").collect()]
    assert got == [("First entry", "2024-01-01", "The story of the first entry, told."), ("Second entry", "2024-01-02", "The story of the second one, told.")]


def test_options(spark):
    rows = page_parts.options(tree(spark, SHOP, "<select><option>x</select>")).where("page_id = 1").orderBy("axis", "place").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("color", 1, "Red", False, True), ("color", 2, "Blue", False, True), ("material", 1, "Merino wool", True, True), ("material", 2, "cotton", False, False),
        ("size", 1, "S", False, True), ("size", 2, "M", True, True), ("size", 3, "L", False, False), ("size", 4, "XL", False, False),
    ]


def test_long_texts(spark):
    given = [
        ("A warm hat. A WARM HAT. Made of wool!\nHat\nColours may vary. S, M, L, XL\nAll rights reserved. It is soft and", "Hat", "A warm hat. Made of wool!"),
        ('{"a": 1}', "x", ""), ("12 34, 56", "x", ""), ("Description", "x", ""), ("<p>One line.</p><p>Read more", "x", "One line."), (None, "x", None), ("Kept : parts", "Kept", "parts"),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(given)], "k int, text string, title string")
    got = {r["k"]: r["t"] for r in df.select("k", page_parts.long_text(F.col("text"), F.col("title")).alias("t")).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(given)}


def test_page_parts_parse_once(spark):
    from loomline.plans import catalogue

    found = catalogue.queries()["page_parts_found"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
