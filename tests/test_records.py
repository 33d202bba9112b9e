"""Listing records and the dispatch of documents."""

from __future__ import annotations

import json

from loomline.operators import records

CARDS = "".join(f'<div class="card"><a href="/p/item-{k}"><img src=/{k}.jpg></a><h3>Product number {k}</h3><span>$ {k}.99</span></div>' for k in range(1, 5))
LIST = {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "position": 1, "item": {"name": "Hat of straw", "url": "/p/hat-1", "offers": {"price": 5}, "image": ["/h.jpg"]}}, {"@type": "ListItem", "name": "Cap of wool", "url": "https://s.com/p/cap-22"}, {"@type": "ListItem", "url": "https://else.com/p/33"}, {"@type": "ListItem", "name": "again", "url": "/p/hat-1"}]}


def page(body, *payloads):
    return "<html><body>" + body + "".join(f"<script type='application/ld+json'>{json.dumps(p)}</script>" for p in payloads) + "</body></html>"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_candidate_sets(spark):
    alone = [{"@type": "Product", "name": f"Thing {k}", "url": f"/thing/{k}x"} for k in (1, 2)]
    pages = spark.createDataFrame(
        [(1, "https://s.com/", page(CARDS)), (2, "https://s.com/", page("<p>x", LIST)), (3, "https://s.com/", page(CARDS, LIST)), (4, "https://s.com/", page("", *alone)), (5, "https://s.com/", page("", alone[0])), (6, "https://s.com/", None)],
        "page_id long, url string, html string",
    )
    sets = records.candidate_sets(pages)
    assert rows(sets.groupBy("page_id", "set_name").count(), "page_id", "set_name", "count") == [(1, "dom", 4), (2, "structured", 2), (3, "dom", 4), (3, "structured", 2), (3, "structured_plus_dom", 6), (4, "structured", 2)]
    assert rows(sets.where("page_id = 2"), "place", "title", "url", "price", "image") == [(1, "Hat of straw", "https://s.com/p/hat-1", "5", "/h.jpg"), (2, "Cap of wool", "https://s.com/p/cap-22", None, None)]
    got = records.listing_records(pages)
    assert rows(got.groupBy("page_id", "set_name", "decision").count(), "page_id", "set_name", "count") == [(1, "dom", 4), (2, "structured", 2), (3, "dom", 4), (4, "structured", 2)]
    assert rows(got.where("page_id = 1"), "place", "title", "url", "price") == [(k, f"Product number {k}", f"https://s.com/p/item-{k}", "marked") for k in range(1, 5)]
    assert records.listing_records(pages, most=2).where("page_id = 1").count() == 2


def test_other_forms_of_a_page(spark):
    pages = spark.createDataFrame([(1, "https://s.com/", page("<p>cut"), page(CARDS)), (2, "https://s.com/", page(CARDS), None)], "page_id long, url string, html string, drawn string")
    seen = spark.createDataFrame([(1, 1, "Box one", "https://s.com/p/box-11", None, None)], "page_id long, place int, title string, url string, price string, image string")
    sets = records.candidate_sets(pages, rendered_col="drawn", visual=seen)
    assert rows(sets.groupBy("page_id", "set_name").count(), "page_id", "set_name", "count") == [(1, "rendered_dom", 4), (1, "visual", 1), (2, "dom", 4)]
    assert rows(records.listing_records(pages, rendered_col="drawn").groupBy("page_id", "set_name").count(), "page_id", "set_name", "count") == [(1, "rendered_dom", 4), (2, "dom", 4)]


def test_gate_lets_no_menu_pass(spark):
    menu = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("login", "cart", "help")) + "</ul>"
    pages = spark.createDataFrame([(1, "https://s.com/", page(menu))], "page_id long, url string, html string")
    assert records.candidate_sets(pages).count() == 3 and records.listing_records(pages).count() == 0
    urls = pages.selectExpr("page_id", "url AS page_url")
    assert records.without_dropped(records.measured(records.candidate_sets(pages), urls)).count() == 0


def test_dispatch(spark):
    prose = "<h1>Heading</h1><article>" + "words of text " * 60 + "</article>"
    documents = [
        ("a", "https://s.com/m", " <?xml version='1.0'?><urlset><url><loc>https://s.com/1</loc></url><url><loc>https://s.com/2</loc></url></urlset>", None, "ecommerce_listing"),
        ("b", "https://s.com/j", '{"items":[{"title":"J","url":"j"}]}', None, "ecommerce_detail"),
        ("c", "https://s.com/c", page(prose), "text/html", "article_detail"),
        ("d", "https://s.com/d", "<h1>Access denied</h1>captcha", "text/html", "ecommerce_listing"),
        ("e", "https://s.com/e", page(CARDS + "words " * 40), "text/html", "ecommerce_listing"),
        ("f", "https://s.com/f", page("<h1>Head</h1>" + "words " * 40, {"@type": "Product", "name": "Named"}), "text/html", "ecommerce_detail"),
        ("g", "https://s.com/g", page("<h1>Only head</h1>" + "words " * 40), "text/html", "job_detail"),
        ("h", "https://s.com/h", None, None, "article_detail"),
    ]
    df = spark.createDataFrame(documents, "page_id string, url string, body string, content_type string, surface string")
    assert rows(records.records(df), "page_id", "route", "place", "title") == [
        ("a", "sitemap", 1, None), ("a", "sitemap", 2, None), ("b", "json", 1, "J"), ("c", "content", 1, "Heading"),
        *(("e", "listing", k, f"Product number {k}") for k in range(1, 5)), ("f", "detail", 1, "Named"), ("g", "detail", 1, "Only head"),
    ]


def test_no_record_is_cut_unless_asked(spark):
    locs = "".join(f"<url><loc>https://s.com/{k}</loc></url>" for k in range(250))
    cards = "".join(f'<div class="card"><a href="/p/item-{k}"></a><h3>Product number {k}</h3></div>' for k in range(250))
    turns = json.dumps({"items": [{"title": f"T{k}", "url": f"u{k}"} for k in range(250)]})
    documents = [("s", "https://s.com/m", f"<urlset>{locs}</urlset>", None, "x"), ("l", "https://s.com/e", page(cards), "text/html", "ecommerce_listing"), ("j", "https://s.com/j", turns, "application/json", "x")]
    df = spark.createDataFrame(documents, "page_id string, url string, body string, content_type string, surface string")
    assert rows(records.records(df).groupBy("page_id").count(), "page_id", "count") == [("j", 250), ("l", 250), ("s", 250)]
    assert rows(records.records(df, most=3).groupBy("page_id").count(), "page_id", "count") == [("j", 3), ("l", 3), ("s", 3)]
