from __future__ import annotations

import json

from loomline.operators import harvest
from loomline.sources import bundle, files, html, json_tree

PAGE = """<html><script type="application/ld+json">{"@graph":[{"@id":"#b","@type":"Brand","name":"Acme"},{"@type":"Product","name":"Hat","brand":{"@id":"#b"}}]}</script>
<meta property="og:title" content="Hat"><table><tr><th>Country</th><th>Population</th></tr><tr><td>France</td><td>68</td></tr><tr><td>Spain</td><td>48</td></tr><tr><td>Italy</td><td>59</td></tr></table></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", "<table><tr><th>x")], "page_id long, url string, html string")
    rows = html.table_rows(pages).orderBy("row").collect()
    assert [r["cells"] for r in rows][0] == {"Country": "France", "Population": "68"} and len(rows) == 3
    found = [r["payload"] for r in html.structured(pages).collect()]
    assert any('"name": "Acme"' in p and '"name": "Hat"' in p for p in found)
    assert html.open_graph(pages).where("page_id = 1").first()["meta"] == {"og:title": "Hat"}


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([("s", "<urlset><url><loc>http://a/x&amp;y</loc></url><url><loc>http://a/z</loc></url></urlset>"), ("i", "<sitemapindex><sitemap><loc>http://a/1.xml</loc></sitemap></sitemapindex>")], "url string, xml string")
    assert {(r["loc"], r["kind"]) for r in files.sitemap(docs).collect()} == {("http://a/x&y", "page"), ("http://a/z", "page"), ("http://a/1.xml", "sitemap")}
    assert files.sitemap(docs, "Z").count() == 1
    bodies = spark.createDataFrame([("u", '[{"title":"a","url":"1"},{"title":"a","url":"1"}]'), ("v", '{"items":[{"title":"b"}]}'), ("w", "{bad")], "url string, body string")
    assert {(r["source_url"], r["title"]) for r in files.json_records(bodies, ["url", "title"]).collect()} == {("u", "a"), ("v", "b")}
    (tmp_path / "u.csv").write_text("url\nhttp://b\nhttp://a\nhttp://b\n")
    assert [r["url"] for r in files.url_list(spark, str(tmp_path / "u.csv")).collect()] == ["http://b", "http://a"]
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /p\nAllow: /p/ok\nUser-agent: x\nDisallow: /")], "host string, body string")
    urls = spark.createDataFrame([("http://a.com/p/1",), ("http://a.com/p/ok/1",), ("http://a.com/q",), ("http://b.com/p",)], "url string")
    assert {r["url"]: r["allowed"] for r in files.allowed(robots, urls).collect()} == {"http://a.com/p/1": False, "http://a.com/p/ok/1": True, "http://a.com/q": True, "http://b.com/p": True}


ODD = """<script type='application/ld+json'>{"@type":"A"}</script><script type=application/ld+json>[{"@type":"B"}]</script><script type="application/ld+json">{bad</script>
<meta property='og:title' content='It'><meta content="big" name=twitter:card><meta property="og:title" content="second">
<script>var t = 1; window.A = {"x": "a } b"}; window['B'] = [1, 2];\nlet c = {not: "json"}; const D = JSON.parse("{\\"y\\":[2]}"); window.E={"z":3}</script>
<table><tr><th>k<th>v<tr><td>a<td><table><tr><td>inner<tr><td>rows</table>after<tr><td>b<td>2<tr><td>c<td>3</table>
<div itemscope itemtype="Product"><span itemprop='name'>Hat <b>red</b></span><div itemprop=offers itemscope><a itemprop=url href="/o">o</a><meta itemprop="price" content="9"></div></div>"""


def test_bundle(spark):
    rows = bundle.bundle(spark.createDataFrame([("p", ODD), ("q", None), ("r", "no tags")], "page_id string, html string")).orderBy("place").collect()
    found = {}
    for r in rows:
        found.setdefault(r["kind"], []).append((r["name"], json.loads(r["payload"])))
    assert [p for _, p in found["jsonld"]] == [{"@type": "A"}, {"@type": "B"}]
    assert found["open_graph"] == [(None, {"og:title": "It", "twitter:card": "big"})]
    assert found["state"] == [("A", {"x": "a } b"}), ("B", [1, 2]), ("D", {"y": [2]}), ("E", {"z": 3})]
    assert [p["cells"] for _, p in found["table"]] == [{"k": "a", "v": "after"}, {"k": "b", "v": "2"}, {"k": "c", "v": "3"}]
    assert found["item"] == [("Product", {"type": "Product", "properties": {"name": ["Hat red"], "offers": [{"type": "", "properties": {"url": ["/o"], "price": ["9"]}}]}})]
    assert [(n, p["value"]) for n, p in found["property"]] == [("name", "Hat red"), ("url", "o"), ("price", "9")]


def test_unpacked():
    packed = [{"user": 1, "tags": 4, "me": 0}, ["Ref", 2], {"name": 3, "again": 1}, "Ann", [3, 5, 99, -1, True], None]
    assert bundle.unpacked(packed) == {"user": {"name": "Ann", "again": None}, "tags": ["Ann", None, None, None, True], "me": None}
    assert bundle.unpacked({"plain": 1}) == {"plain": 1} and bundle.unpacked([]) == []
    doubling = [[k + 1, k + 1] for k in range(60)] + ["end"]
    assert bundle.unpacked(doubling) is doubling
    deep = [[k + 1] for k in range(5000)] + ["end"]
    assert bundle.unpacked(deep) is deep


def test_json_tree(spark):
    deep = "[" * 80 + "7" + "]" * 80
    docs = [(1, '{"a":[1,{"b c":null}],"d":{"@type":"T","e":true}}'), (2, deep), (3, "{bad"), (4, None), (5, '"x"'), (6, "[" * 100_000)]
    df = spark.createDataFrame(docs, "id int, doc string")
    got = {}
    for r in json_tree.leaves(df, "doc", ["id"]).orderBy("place").collect():
        got.setdefault(r["id"], []).append((r["path"], r["kind"], r["value"], r["keys"], r["types"]))
    assert got == {1: [("$.a[0]", "number", "1", ["a"], []), ('$.a[1]."b c"', "null", None, ["a"], []), ('$.d."@type"', "string", "T", ["d"], ["T"]), ("$.d.e", "boolean", "true", ["d"], ["T"])], 5: [("$", "string", "x", [], [])]}
    assert json_tree.leaves(df, "doc", ["id"], 90).where("id = 2").first()["value"] == "7"
    assert json_tree.values(df, "doc", ["id"]).where("id = 2").agg({"depth": "max"}).first()[0] == json_tree.DEEPEST


def test_candidates(spark):
    doc = """{"@type":["Product","Thing"],"name":"Hat","Brand Name":{"@type":"Brand","label":"Acme"},"sizes":["S","M","S"],"review":[{"@type":"Review","name":"so so","description":"bad"}],"hasVariant":[{"name":"Hat S"}],
      "additionalProperty":[{"name":"Stuff","value":"wool"},{"name":"other","value":"x"},{"value":"y"}],"list":{"@type":"ItemList","itemListElement":[{"@type":"ListItem","name":"no"}]},
      "trail":{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","item":{"name":"Home"}},{"@type":"ListItem","name":" Hats "}]},"description":" "}"""
    aliases = spark.createDataFrame([("name", "title"), ("label", "brand"), ("sizes", "size"), ("stuff", "material"), ("description", "description")], "alias string, field string")
    got = [tuple(r) for r in harvest.candidates(spark.createDataFrame([(1, doc), (2, "[]"), (3, None)], "id int, doc string"), "doc", ["id"], aliases).orderBy("field", "place").collect()]
    assert got == [(1, "brand", 1, "key", "Acme"), (1, "category", 1, "breadcrumb", "Home > Hats"), (1, "material", 1, "pair", "wool"), (1, "size", 1, "key", "S"), (1, "size", 2, "key", "M"), (1, "title", 1, "key", "Hat")]


def test_sitemap_tree(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    urls = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    documents = spark.createDataFrame([("r", index("a", "b", "gone")), ("a", index("r", "a", "c")), ("b", urls("http://x/1", "http://x/2")), ("c", urls("http://x/2", "http://x/3")), ("other", urls("http://y"))], "url string, xml string")
    roots = spark.createDataFrame([("r",), ("c",), ("none",)], "url string")
    assert {tuple(r) for r in files.sitemap_pages(roots, documents).collect()} == {("r", "http://x/1", 1), ("r", "http://x/2", 1), ("r", "http://x/3", 2), ("c", "http://x/2", 0), ("c", "http://x/3", 0)}
    assert {tuple(r) for r in files.sitemap_pages(roots, documents, keyword="X/", most=2).collect()} == {("r", "http://x/1", 1), ("r", "http://x/2", 1), ("c", "http://x/2", 0), ("c", "http://x/3", 0)}


def test_robots_groups_and_patterns(spark):
    body = "Sitemap: z\nUser-agent: *\nUser-agent: x\nDisallow: /a\nAllow: /a/*.html$\nDisallow: /q?*id=\n\nUser-agent: y\nDisallow: /\nUser-agent: *\nDisallow: /late # more\nDisallow:"
    robots = spark.createDataFrame([("h", body), ("k", "Disallow: /\nUser-agent: y\nDisallow: /")], "host string, body string")
    want = {"http://h/a/x": False, "http://h/a/x.html": True, "http://h/a/x.html?p": False, "http://h/q?n=1&id=2": False, "http://h/q?n=1": True, "http://h/late/1": False, "http://h/b": True, "http://k/": True}
    assert {r["url"]: r["allowed"] for r in files.allowed(robots, spark.createDataFrame([(u,) for u in want], "url string")).collect()} == want


def test_first_of_equal_records(spark):
    bodies = spark.createDataFrame([("u", '[{"title":"a","url":"1","price":"5"},{"title":"a","url":"1","price":"6"},{"title":"a","url":"2"}]')], "url string, body string")
    assert {(r["url"], r["price"]) for r in files.json_records(bodies, ["url", "title", "price"]).collect()} == {("1", "5"), ("2", None)}


def test_small_pages_share_batches():
    import pyarrow as pa

    from loomline.sources import dom

    htmls = pa.array(["<p>a", None, "", "<p>b<p>c"] * 2000 + ["x" * dom.BATCH_CHARS, "<p>d"])
    got = list(dom.in_batches(htmls, lambda html: [r["tag"] for r in dom._Parser().page(html)]))
    assert len(got) == 3 and [p for places, _ in got for p in places][:6] == [0, 0, 3, 3, 3, 3] and sum(len(rows) for _, rows in got) == 4 * 2000 + 2 * 2000 + 4
    assert all(len(places) == len(rows) for places, rows in got)


def test_few_bytes_with_much_work_are_dealt_out(spark):
    from loomline.plans import catalogue

    # one file of parts is read by one task; its pages are parsed by as many as a shuffle has
    assert catalogue.queries()["source_bundles"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
