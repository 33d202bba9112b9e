"""Trees of pages against plain walks."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import selectors, trees
from loomline.sources import dom

SHOP = """<!doctype html><html lang=en><body class="page dark"><header><nav><a href="/">Home</a><a href=/all>All</a></nav></header>
<div id="grid"><div class="card product" data-id="a-1"><a href="/p/1"><img src=/1.jpg alt="One"></a><h3>First &amp; best</h3><span class=price>$ 9.99</span></div>
<div class="card product"><a href="/p/2"><img src="/2.jpg"></a><h3>Second</h3><span class=price>12 EUR</span></div><div class='card promo wide'>no link</div></div>
<ul><li><a href='/x?y=1'>X</a><li><a href="/z">Z</a><ul><li>deep<li>deeper</ul></ul>
<script>if (a < b) document.write("<div class=card></div>")</script><p>Unclosed <b>bold <i>both</b> tail<p>Next<table><tr><td>1<td>2<tr><td>3</table></body></html> after"""
ARTICLE = """<body><article><h1>Title</h1><p>One <strong>two</strong>, <em>three</em> and <code>x = 1</code>.</p><ul><li>a<li>b<ol><li>first<li>second</ol></ul>
<p>See <a href="../up">that <b>page</b></a><br>now.</p><pre class="language-py"><code>def f():
    return 1
</code></pre><table><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></tbody></table>
<img src="pic.png" alt="A pic"><blockquote>said</blockquote><script>var x;</script></article></body>"""
MARKDOWN = """# Title

One **two**, *three* and `x = 1`.

- a
- b
  1. first
  2. second

See [that **page**](https://e.com/up)
now.

```py
def f():
    return 1

```

| k | v |
| --- | --- |
| a | 1 |
| b | 2 |

![A pic](https://e.com/d/pic.png)

> said"""
CSS = ["div", "*", "#grid", ".card", "div.card.product", "[data-id]", "[data-id='a-1']", "[data-id|=a]", "[class~=wide]", "[href^='/p']", "[src$=jpg]", "[class*=rod]", "body > div > div", "div a img", "h3 + span", "a ~ .price",
    "li:first-child", "li:last-child", "div > :nth-child(2)", "li:nth-child(odd)", ".card:nth-last-child(1)", "td:nth-of-type(2)", "a:only-child", ".card:not(.product)", "div:not([id])", "ul ul li", "ul > li > a, h3", "tr + tr td", "nav a:last-of-type", "a:not(:first-child)", "b i", "div div div"]
PATHS = ["//a/@href", "/html/body/div", "//li[2]", "//li[last()]/a", "//div[@class='card product'][1]/h3", "//*[@id='grid']//img/@src", "//a[starts-with(@href, '/p')]", "//span[contains(@class, 'price')]/text()", "//h3[text()='Second']", "//p[contains(text(), 'tail')]", "//div[@id and @class]", "//ul//a | //nav/a"]


def tree_of(html):
    return [r for r in dom._Parser().page(html)]


def holds(test, node, rows):
    kind, name, value, a, b, negated = test
    attrs = dict(node["attrs"])
    others = [r for r in rows if r["parent"] == node["parent"] and r["tag"] != "#text"]
    same = [r for r in others if r["tag"] == node["tag"]]
    at = attrs.get(name)
    place = {"child": lambda: others.index(node) + 1, "last-child": lambda: len(others) - others.index(node), "nth": lambda: same.index(node) + 1, "last-nth": lambda: len(same) - same.index(node)}
    if kind in place:
        found = place[kind]() in ({b} if a == 0 else {a * n + b for n in range(200)})
    else:
        found = {
            "has": lambda: at is not None, "=": lambda: at == value, "~=": lambda: at is not None and value in at.split(), "^=": lambda: bool(at and at.startswith(value)), "$=": lambda: bool(at and at.endswith(value)), "*=": lambda: bool(at and value in at),
            "|=": lambda: at is not None and (at == value or at.startswith(value + "-")), "tag": lambda: node["tag"] == name, "only": lambda: len(others) == 1, "text=": lambda: " ".join(node["text"].split()) == value, "text*=": lambda: value in node["text"],
        }[kind]()
    return found != negated


def walk(branch, rows):
    """pre of the nodes that a branch names, step by step from every node."""
    elements = [r for r in rows if r["tag"] != "#text"]
    joint, tag, tests, _ = branch[0]
    fits = lambda r, tag, tests: tag in ("*", r["tag"]) and all(holds(t, r, rows) for t in tests)
    found = [r for r in elements if fits(r, tag, tests) and (joint == " " or r["parent"] is None)]
    for joint, tag, tests, _ in branch[1:]:
        after = []
        for r in elements:
            parents, x = [], r
            while x["parent"] is not None:
                x = rows[x["parent"]]
                parents.append(x)
            before = [s for s in elements if s["parent"] == r["parent"] and s["pre"] < r["pre"]]
            near = {" ": parents, ">": parents[:1], "+": before[-1:], "~": before}[joint]
            if fits(r, tag, tests) and any(n is f for n in near for f in found):
                after.append(r)
        found = after
    return {r["pre"] for r in found}


def test_selectors(spark):
    pages = {1: SHOP, 2: ARTICLE, 3: "", 4: None, 5: "<p>a<p class=card>b</p>" * 3}
    chance = random.Random(1)
    for k in range(6, 12):
        pages[k] = "".join(chance.choice(["<div class=card>", "</div>", "<ul>", "<li>", "</ul>", "<a href=/p>", "</a>", "<p>", "text ", "<span class=price>", "</span>", "<h3>", "</h3>"]) for _ in range(120))
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    named = [(f"c{k}", "css", s) for k, s in enumerate(CSS)] + [(f"x{k}", "xpath", s) for k, s in enumerate(PATHS)]
    steps = selectors.compiled(spark, named)
    got = {}
    for r in selectors.matches(dom.nodes(df), steps, 4).select("selector", "page_id", "pre").collect():
        got.setdefault((r["selector"], r["page_id"]), set()).add(r["pre"])
    want = {}
    for name, kind, text in named:
        for page, html in pages.items():
            rows = tree_of(html or "")
            if found := set().union(*(walk(b, rows) for b in {"css": selectors.css, "xpath": selectors.xpath}[kind](text))):
                want[name, page] = found
    assert got == want
    assert {name for name, _ in want} == {n for n, *_ in named} - {"x10"}


def test_values(spark):
    df = spark.createDataFrame([(1, SHOP), (2, None)], "page_id long, html string")
    named = [("price", "css", ".price"), ("image", "css", ".card img"), ("links", "css", "#grid a"), ("title", "xpath", "//h3/text()"), ("id", "xpath", "//div/@data-id"), ("li", "css", "ul > li"), ("digits", "regex", r"/p/(\d)|(zzz)"), ("word", "regex", "Sec\\w+")]
    got = {}
    for r in selectors.values(df, named).orderBy("place").collect():
        got.setdefault(r["selector"], []).append(r["value"])
    assert got == {"price": ["$ 9.99", "12 EUR"], "image": ["/1.jpg", "/2.jpg"], "links": ["/p/1", "/p/2"], "title": ["First & best", "Second"], "id": ["a-1"], "li": ["X", "Z deep deeper", "deep", "deeper"], "digits": ["1", "2"], "word": ["Second"]}
    one = selectors.tested(df, css_selector=".price", path="//b[@x]", pattern=r"(\d+)\D").collect()
    assert [tuple(r) for r in one] == [(1, "9", 2, ".price")]
    assert [tuple(r) for r in selectors.tested(df, pattern="lang=(\\w+)").collect()] == [(1, "en", 1, "lang=(\\w+)")]
    assert selectors.tested(df, css_selector="video").collect() == []


@pytest.mark.parametrize("text", ["div >", "a[b", "div::before", ":hover", "//a/@b/c", "a/b", "//a[count(b)]", "div & p"])
def test_selectors_that_are_none(text):
    with pytest.raises(ValueError, match="."):
        (selectors.xpath if "/" in text else selectors.css)(text)


def test_intervals():
    for html in (SHOP, ARTICLE, "<p>" * 2000 + "x", "</div>text<b>", "<table><tr><td><table><tr><td>in</table>out"):
        rows = tree_of(html)
        for r in rows:
            below = [x for x in rows if r["pre"] < x["pre"] <= r["last"]]
            kids = [x for x in rows if x["parent"] == r["pre"] and x["tag"] != "#text"]
            assert all(x["parent"] is not None and r["pre"] <= x["parent"] for x in below)
            assert r["children"] == len(kids) and [k["child"] for k in kids] == list(range(1, len(kids) + 1))
            assert r["links"] == sum(x["tag"] == "a" and "href" in dict(x["attrs"]) for x in [r, *below]) and r["images"] == sum(x["tag"] == "img" for x in [r, *below])
            words = " ".join(" ".join(x["text"].split()) for x in [r, *below] if x["tag"] == "#text" and not x["silent"] and x["text"].strip())
            assert rows[0]["flow"][r["start"] : r["end"]].strip() == words
    assert max(r["depth"] for r in tree_of("<i>" * 5000 + "x")) <= dom.DEEPEST + 1


def test_references_end_with_a_semicolon():
    rows = tree_of("<p title='a&amp;b&amp' data-u='?a=1&timestamp=2&copy=3'>a &amp;lt; &lt;i&gt; &copy &copy; &notit; &#65;&#x42; &#67 &am &amp</p><script>a&&b&amp;&c</script>t &quo")
    assert [(r["tag"], r["text"]) for r in rows if r["tag"] != "#text"] == [("p", "a &lt; <i> &copy © &notit; AB &#67 &am &amp"), ("script", "a&&b&amp;&c"), ("html", "t &quo")]
    assert dict(rows[0]["attrs"]) == {"title": "a&b&amp", "data-u": "?a=1&timestamp=2&copy=3"}


def test_cards(spark):
    tree = dom.nodes(spark.createDataFrame([(1, SHOP), (2, "<div><p>a<p>b</div>")], "page_id long, html string"))
    got = [tuple(r) for r in trees.cards(tree).where("signature LIKE 'div%'").select("page_id", "place", "signature", "title", "href").orderBy("page_id", "place").collect()]
    assert got == [(1, 1, "div|card|1|1|price|h3|p|id|2", "First & best", "/p/1"), (1, 2, "div|card|1|1|price|h3|p|id|2", "Second", "/p/2")]


def test_main_text(spark):
    prose = "<p>" + "long words of prose " * 20 + "</p>"
    pages = [
        (1, f"<nav>{'<a href=/>menu</a>' * 99}</nav><div><div class=x>{prose * 3}<a href=/>more</a></div><div>short</div></div>", "div", "dense"),
        (2, f"<div>{prose * 5}</div><div role=main>{prose}</div>", "div", "named"),
        (3, "<body>nothing here</body>", "body", "page"),
        (4, f"<article>a</article><article>{prose}</article>", "article", "named"),
        (5, f"<footer><main>{prose}</main></footer><td>x</td>", None, None),
    ]
    got = {r["page_id"]: (r["tag"], r["found"], r["content"]) for r in trees.main_text(dom.nodes(spark.createDataFrame([p[:2] for p in pages], "page_id long, html string"))).collect()}
    assert {k: v[:2] for k, v in got.items() if k != 5} == {p[0]: p[2:] for p in pages if p[2]}
    assert got[1][2].startswith("long words") and got[1][2].endswith("more") and "short" not in got[1][2] and len(got[4][2]) > 100


def test_markdown(spark):
    pages = spark.createDataFrame([(1, "https://e.com/d/page", ARTICLE), (2, "https://e.com/", None)], "page_id long, url string, html string")
    rows = trees.markdown(dom.nodes(pages), pages).collect()
    assert [(r["page_id"], r["markdown"]) for r in rows] == [(1, MARKDOWN)]
    # what it says is in the page, and what the page says is in it
    plain = lambda t: re.sub(r"[^a-z0-9]+", "", t.lower())
    assert plain(re.sub(r"\]\([^)]*\)|```py|!\[[^\]]*|\d\. ", "", MARKDOWN)) == plain(re.sub(r"<script>.*?</script>|<[^>]*>", " ", ARTICLE))


def test_extractability(spark):
    html = "<main><h2>Description</h2><p>What it is.</p><h2>Care</h2><h2>Empty</h2></main><span class=price>1</span>"
    pages = spark.createDataFrame([(1, html), (2, "<p>x</p>")], "page_id long, html string")
    aliases = spark.createDataFrame([("description", "description"), ("care", "care")], "alias string, field string")
    found = selectors.values(pages, [("price", "css", ".price")])
    rows = trees.extractability(dom.nodes(pages), found, aliases, ["description", "care", "size"]).orderBy("page_id").collect()
    assert [(r["section_fields"], r["selector_fields"], r["matched"], r["verified"]) for r in rows] == [(["description"], ["price"], ["description"], True), ([], [], [], False)]
    assert trees.sections(dom.nodes(pages)).where(F.col("label") == "Care").first()["chars"] <= 1
