"""Records of documents: listings by the best of several candidate sets, and the dispatch of a document by what it is.

A candidate set is rows, not a list held anywhere: (page, set, place, title, url, price, image, signature). All sets of all
pages are scored by one aggregation, the first of each page by its comparands is gated, and its records are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import text as X
from ..functions import url as U
from ..sources import bundle, dom, files, html, store
from . import listing, operations, trees

#: In the order in which ties are settled.
SETS = ["structured", "dom", "structured_plus_dom", "original_dom", "rendered_dom", "visual"]
#: Fewest payloads of one type that make a listing without a list around them.
LEAST_ITEMS = 2
#: Our own defaults.
ITEM_TYPES = ["product", "jobposting", "article", "newsarticle", "blogposting", "event", "recipe", "book", "movie"]
NOISE_TITLES = ["home", "next", "previous", "more", "login", "sign in", "menu", "search", "cart", "the", "and", "to", "of"]
UTILITY_PARTS = r"(?i)^/(?:login|signin|account|cart|checkout|help|contact|about|privacy|terms|search|the|and|to|of)/?$"
_RECORD = ["page_id", "set_name", "place", "title", "url", "price", "image", "signature"]


def structured_items(payloads: DataFrame, urls: DataFrame) -> DataFrame:
    """Records (page_id, place, title, url, price, image) of JSON-LD (page_id, place, payload): the elements of item lists, and
    payloads of one item type that stand LEAST_ITEMS times or more on the page. One record a URL of the page's host."""
    at = lambda c, *paths: F.coalesce(*(F.try_variant_get(c, p, "string") for p in paths))
    parsed = payloads.select("page_id", "place", F.try_parse_json("payload").alias("v")).where("v IS NOT NULL").withColumn("_type", F.lower(F.coalesce(at(F.col("v"), "$['@type']"), F.lit(""))))
    listed = parsed.where(F.col("_type").contains("itemlist")).select("page_id", "place", F.posexplode(F.try_variant_get("v", "$.itemListElement", "array<variant>")).alias("inner", "e"))
    listed = listed.select("page_id", "place", "inner", F.coalesce(F.try_variant_get("e", "$.item", "variant"), F.col("e")).alias("e"), F.col("e").alias("outer"))
    alike = F.count("*").over(Window.partitionBy("page_id", "_type"))
    alone = parsed.where(F.col("_type").isin(*ITEM_TYPES)).withColumn("_n", alike).where(F.col("_n") >= LEAST_ITEMS).select("page_id", "place", F.lit(0).alias("inner"), F.col("v").alias("e"), F.col("v").alias("outer"))
    item = listed.unionByName(alone).join(urls, "page_id")
    e, outer = F.col("e"), F.col("outer")
    href = F.coalesce(at(e, "$.url", "$.link", "$.href", "$['@id']"), at(outer, "$.url"), F.try_variant_get(e, "$", "string"))
    out = item.select(
        "page_id", "place", "inner", V.absolute_url(F.col("page_url"), href).alias("url"), "page_url", X.clean_text(F.coalesce(at(e, "$.name", "$.title", "$.headline"), at(outer, "$.name"), U.terminal_text(href))).alias("title"),
        at(e, "$.offers.price", "$.offers[0].price", "$.offers.lowPrice", "$.price").alias("price"), at(e, "$.image[0]", "$.image.url", "$.image").alias("image"),
    )
    out = out.where((F.coalesce("title", F.lit("")) != "") & U.same_site(F.col("url"), F.col("page_url")) & (F.col("url") != F.col("page_url")))
    first = out.groupBy("page_id", "url").agg(F.min_by(F.struct("title", "price", "image"), F.struct("place", "inner")).alias("r"), F.min(F.struct("place", "inner")).alias("at"))
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("at", "url")).alias("place"), "r.title", "url", "r.price", "r.image")


def card_items(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Records of a page's cards, as structured_items, with the cards' signatures; the first card of each address stays."""
    tree = store.kept(dom.nodes(pages, "page_id", html_col), "nodes")
    cards = trees.cards(tree).join(pages.select("page_id", F.col("url").alias("_base")), "page_id")
    out = cards.select("page_id", "place", "title", V.absolute_url(F.col("_base"), F.col("href")).alias("url"), F.lit(None).cast("string").alias("price"), F.lit(None).cast("string").alias("image"), "signature", F.split("signature", r"\|")[4].alias("_price"))
    out = out.withColumn("price", F.when(F.col("_price") == "price", "marked")).drop("_price").where("title <> ''")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("place"))).where("_n = 1").drop("_n")


def _titled(records: DataFrame, name: str) -> DataFrame:
    signature = F.col("signature") if "signature" in records.columns else U.shape_signature(F.col("url"))
    return records.withColumn("signature", signature).withColumn("set_name", F.lit(name)).select(*_RECORD)


def candidate_sets(pages: DataFrame, original_col: str | None = None, rendered_col: str | None = None, visual: DataFrame | None = None) -> DataFrame:
    """The records of each candidate set of each page (page_id, url, html): of JSON-LD, of cards, of both, and of cards in the
    columns that hold the page as it came or as it was drawn, if there are such; visual: records read from boxes."""
    urls = pages.select("page_id", F.col("url").alias("page_url"))
    structured = store.kept(_titled(structured_items(bundle.bundle(pages).where("kind = 'jsonld'"), urls), "structured"), "structured")
    cards = store.kept(_titled(card_items(pages), "dom"), "cards")
    # a set for both only where both have records; cards first, and of equal addresses the first
    both = cards.join(structured.select("page_id").distinct(), "page_id", "left_semi").withColumn("_s", F.lit(0)).unionByName(structured.join(cards.select("page_id").distinct(), "page_id", "left_semi").withColumn("_s", F.lit(1)))
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("_s", "place"))).where("_n = 1").withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("_s", "place")))
    out = structured.unionByName(cards).unionByName(_titled(both.drop("_s", "_n"), "structured_plus_dom"))
    for name, column in (("original_dom", original_col), ("rendered_dom", rendered_col)):
        if column:
            out = out.unionByName(_titled(card_items(pages.where(F.coalesce(column, F.lit("")) != ""), column), name))
    return out.unionByName(_titled(visual, "visual")) if visual is not None else out


def measured(records: DataFrame, urls: DataFrame) -> DataFrame:
    """Adds what the sets' comparands need: score, supported, detail_like and utility of each record."""
    r = records.join(urls, "page_id")
    path = U.path(F.col("url"))
    detail = path.rlike(r"/[^/]{6,}$") | path.rlike(r"/(?:p|product|products|item|job|jobs)/[^/]+")
    utility = path.rlike(UTILITY_PARTS)
    structural = F.col("url").isNull() | path.isin("", "/") | (F.col("url") == F.col("page_url"))
    noise, priced = F.lower("title").isin(*NOISE_TITLES), F.col("price").isNotNull()
    supported = priced | F.col("image").isNotNull() | (F.length("title") >= 5)
    return r.withColumn("score", listing.record_score(F.col("title"), ~structural, detail, noise, priced, utility)).withColumn("supported", supported).withColumn("detail_like", detail).withColumn("utility", utility)


def without_dropped(measures: DataFrame, surface: Column | None = None) -> DataFrame:
    """Records of measured() but for those that operations.dropped() names. A record has merchandise with a price or an image,
    a title of 12 characters or more to fall back on, and is a job's by its surface."""
    job = F.coalesce(surface.startswith("job_"), F.lit(False)) if surface is not None else F.lit(False)
    flagged = measures.withColumn("detail", F.col("detail_like")).withColumn("merchandise", F.col("price").isNotNull() | F.col("image").isNotNull()).withColumn("fallback", F.length("title") >= 12).withColumn("job", job)
    return flagged.where(~operations.dropped()).drop("detail", "merchandise", "fallback", "job")


def listing_records(pages: DataFrame, most: int | None = None, **sources) -> DataFrame:
    """page_id, set_name, decision, place, title, url and price: the records of each page's best candidate set, the first `most`
    of them where a number is given, where the integrity gate lets the set pass. A page without any has no rows."""
    urls = pages.select("page_id", F.col("url").alias("page_url"))
    records = store.kept(measured(candidate_sets(pages, **sources), urls).withColumn("_order", F.array_position(F.array(*map(F.lit, SETS)), F.col("set_name"))), "candidates")
    best = listing.gate(listing.best_set(listing.set_scores(records, ["page_id", "set_name", "_order"]), "page_id", "_order"))
    passed = best.where("decision = 'product_grid'").select("page_id", "set_name", "decision")
    placed = records.join(passed, ["page_id", "set_name"]).withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("place", "url")))
    return _first(placed, most).select("page_id", "set_name", "decision", "place", "title", "url", "price")


def _first(records: DataFrame, most: int | None) -> DataFrame:
    return records if most is None else records.where(F.col("place") <= most)


# --- dispatch ----------------------------------------------------------------------------------------------------


def route(body: Column, content_type: Column, surface: Column, blocked: Column) -> Column:
    """What a document is taken for: sitemap, json, content, blocked, listing or detail, the first that fits."""
    start = F.lower(F.substring(F.trim(F.regexp_replace(body, "^﻿", "")), 1, 400))
    xml = start.rlike(r"(?s)^(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*)?<(?:\w+:)?(?:urlset|sitemapindex)\b")
    json = F.lower(F.coalesce(content_type, F.lit(""))).contains("json") | start.rlike(r"^[{\[]")
    content = surface.isin("content_detail", "article_detail", "forum_detail")
    return F.when(xml, "sitemap").when(json, "json").when(content, "content").when(blocked, "blocked").when(surface.contains("listing"), "listing").otherwise("detail")


def records(documents: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, route, place, title and url of the records of documents (page_id, url, body, content_type, surface): all, or the
    first `most` of each document where a number is given.

    Each document goes one way: the pages a sitemap names; the records of a JSON body; a content page's main text, where it
    has a title or text; nothing of a blocked page; the records of a listing; of any other page its product, or its title."""
    flags = html.block_flags(documents.select("page_id", F.coalesce("body", F.lit("")).alias("html"))).select("page_id", (F.col("blocked") | F.col("shell")).alias("_blocked"))
    sent = store.kept(documents.join(flags, "page_id").withColumn("route", route(F.coalesce("body", F.lit("")), F.col("content_type"), F.col("surface"), F.col("_blocked"))), "sent")
    way = lambda name: sent.where(F.col("route") == name)
    pages = lambda name: way(name).select("page_id", "url", F.col("body").alias("html"))
    out = []
    entries = files.sitemap(way("sitemap").select(F.col("page_id").alias("url"), F.col("body").alias("xml"))).where("kind = 'page'")
    out.append(entries.select(F.col("url").alias("page_id"), F.lit("sitemap").alias("route"), (F.col("place") + 1).alias("place"), F.lit(None).cast("string").alias("title"), F.col("loc").alias("url")))
    listed = files.json_records(way("json").select(F.col("page_id").alias("url"), "body"), ["title", "url"])
    out.append(listed.select(F.col("source_url").alias("page_id"), F.lit("json").alias("route"), F.row_number().over(Window.partitionBy("source_url").orderBy("title", "url")).alias("place"), "title", "url"))
    content = html.content_record(pages("content")).where("title <> '' OR content <> ''")
    out.append(content.select("page_id", F.lit("content").alias("route"), F.lit(1).alias("place"), "title", "url"))
    out.append(listing_records(pages("listing"), most).select("page_id", F.lit("listing").alias("route"), "place", "title", "url"))
    # a detail page's title: of its first product, else of the page's properties, else its heading
    detail = pages("detail")
    found = bundle.bundle(detail).where(F.col("kind").isin("jsonld", "open_graph"))
    name = F.when((F.col("kind") == "jsonld") & F.get_json_object("payload", "$['@type']").isin("Product", "JobPosting"), F.coalesce(F.get_json_object("payload", "$.name"), F.get_json_object("payload", "$.title"))).when(F.col("kind") == "open_graph", F.get_json_object("payload", "$['og:title']"))
    best = found.withColumn("_name", name).where("_name <> ''").groupBy("page_id").agg(F.min_by("_name", F.struct(F.col("kind") == "open_graph", "place")).alias("_name"))
    title = F.coalesce("_name", F.nullif(html.first_heading(F.col("html")), F.lit("")))
    out.append(detail.join(best, "page_id", "left").select("page_id", F.lit("detail").alias("route"), F.lit(1).alias("place"), title.alias("title"), "url").where("title IS NOT NULL"))
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return _first(every, most)
