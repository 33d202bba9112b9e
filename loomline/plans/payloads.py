"""Queries over payloads within pages and files: JSON at any depth, packed states, bundles, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import harvest, page_parts, snapshots, typed
from ..sources import bundle, dom, files, json_tree, store
from .registry import dealt, registered, table
from .urls import _HOST, _PATH

_TREE = """SELECT {keep}, replace(fullkey, '"', '') AS path, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS kind, atom AS value
      FROM {source}, json_tree({doc}) WHERE type NOT IN ('OBJECT', 'ARRAY')"""


@registered(_TREE.format(keep="event_id", source="events", doc="props").replace("atom AS value", "json_extract_string(props, fullkey) AS value"))
def event_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the events' properties, with their paths."""
    return json_tree.leaves(table(spark, sf_dir, "events"), "props", ["event_id"]).select("event_id", "path", "kind", "value")


@registered(
    """WITH d AS (SELECT conv_id, to_json({'conv': conv_id, 'turns': list({'turn': turn, 'by': {'role': role, 'words': string_split(text, ' ')}} ORDER BY turn)}) AS doc FROM conversations GROUP BY 1)
    SELECT conv_id, replace(fullkey, '"', '') AS path, CASE WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, json_extract_string(doc, fullkey) AS value FROM d, json_tree(doc) WHERE type NOT IN ('OBJECT', 'ARRAY')"""
)
def conversation_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of conversations as nested JSON."""
    turn = F.struct("turn", F.struct("role", F.split("text", " ", -1).alias("words")).alias("by"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.first("conv_id").alias("conv"), F.array_sort(F.collect_list(turn)).alias("turns"))).alias("doc"))
    return json_tree.leaves(docs, "doc", ["conv_id"]).select("conv_id", "path", "kind", "value")


#: A product as shops write it: the name twice, a brand within an object, pairs, a review, variants, a trail.
_PRODUCT = """'{"@graph":[{"@type":"Product","name":"' || p_name || '","brand":{"@type":"Brand","name":"' || p_brand || '"},"offers":[{"@type":"Offer","price":' || p_size || '}],"additionalProperty":[{"name":"Box Kind","value":"B' || p_size || '"},{"name":"Else","value":"x"}],"review":{"@type":"Review","name":"fine","author":"M' || p_partkey || '"},"hasVariant":[{"name":"no"}],"title":"' || p_type || '"},{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home"},{"@type":"ListItem","position":2,"name":"' || p_type || '"}]}]}'"""
_ALIASES = [("name", "title"), ("title", "title"), ("price", "price"), ("box_kind", "material"), ("author", "reviewer")]


@registered(
    """SELECT p_partkey, field, place::INT AS place, source, trim(value) AS value FROM part, LATERAL (VALUES ('title', 1, 'key', p_name), ('title', 2, 'key', p_brand), ('title', 3, 'key', p_type), ('price', 1, 'key', p_size::VARCHAR), ('material', 1, 'pair', 'B' || p_size), ('reviewer', 1, 'key', 'M' || p_partkey), ('category', 1, 'breadcrumb', 'Home > ' || p_type)) v(field, place, source, value)"""
)
def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of fields from products' JSON, wherever a name or an alias stands."""
    docs = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PRODUCT).alias("doc"))
    return harvest.candidates(docs, "doc", ["p_partkey"], spark.createDataFrame(_ALIASES, "alias string, field string"))


_PACKED = """'<script type=application/json id="__NUXT_DATA__">[{"data":1},["Reactive",2],{"item":3,"again":3,"list":6},{"name":4,"brand":5,"self":3},"' || p_name || '","' || p_brand || '",[4,7],' || (p_size + 100) || ']</script>'"""


@registered("SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, p_brand AS again, p_name AS first, (p_size + 100)::VARCHAR AS second, true AS cut FROM part")
def packed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States whose objects and lists hold places of a packed list; one of them holds itself."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_PACKED).alias("html"))
    states = bundle.bundle(pages).where("kind = 'state' AND name = '__NUXT_DATA__'")
    at = lambda path: F.get_json_object("payload", f"$.data.{path}")
    return states.select("page_id", at("item.name").alias("name"), at("item.brand").alias("brand"), at("again.brand").alias("again"), at("list[0]").alias("first"), at("list[1]").alias("second"), at("item.self").isNull().alias("cut"))


_WHOLE = """'<head><meta content="' || p_name || '" property=og:title><script type=''application/ld+json''>{"@type":"Product","name":"' || p_name || '"}</script><script>window.A = {"a":' || p_size || '};var B=[' || p_partkey || '];window["C"]=JSON.parse("{\\\\"c\\\\":1}"); self.__next_f.push([1,"2:{\\\\"d\\\\":2}"])</script></head><div itemscope itemtype=T><i itemprop=''name''>' || p_name || '</i><b itemprop=brand itemscope><u itemprop=title>' || p_brand || '</u></b></div><script type="application/json" id=s>{"e":[1]}</script><table><tr><th>k<th>v<tr><td>a<td><table><tr><td>in</table>' || p_type || '<tr><td>b<td>2<tr><td>c<td>3</table>'"""


@registered(
    """SELECT p_partkey AS page_id, kind, name, payload FROM part, LATERAL (VALUES ('jsonld', NULL, '{"@type": "Product", "name": "' || p_name || '"}'), ('state', 'A', '{"a": ' || p_size || '}'), ('state', 'B', '[' || p_partkey || ']'), ('state', 'C', '{"c": 1}'), ('state', '__NEXT_F__', '{"d": 2}'),
      ('script', 's', '{"e": [1]}'), ('open_graph', NULL, '{"og:title": "' || p_name || '"}'), ('property', 'name', '{"property": "name", "value": "' || p_name || '"}'), ('property', 'title', '{"property": "title", "value": "' || p_brand || '"}'),
      ('item', 'T', '{"type": "T", "properties": {"name": ["' || p_name || '"], "brand": [{"type": "", "properties": {"title": ["' || p_brand || '"]}}]}}'),
      ('table', NULL, '{"table": 0, "row": 1, "cells": {"k": "a", "v": "' || p_type || '"}}'), ('table', NULL, '{"table": 0, "row": 2, "cells": {"k": "b", "v": "2"}}'), ('table', NULL, '{"table": 0, "row": 3, "cells": {"k": "c", "v": "3"}}')) v(kind, name, payload)"""
)
def source_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything structured in a page, by one parse."""
    pages = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(_WHOLE).alias("html"))
    return bundle.bundle(pages).select("page_id", "kind", "name", "payload")


@registered(f"""SELECT DISTINCT 'root' AS root, url AS loc, 2 AS depth FROM (SELECT trim(url) AS url, {_HOST} AS host FROM pages) WHERE contains(lower(url), 'en')""")
def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a tree of sitemaps names: an index of hosts, an index a host that names its pages' file and the first index again."""
    pages = table(spark, sf_dir, "pages").select(F.trim("url").alias("url"), U.hostname(F.col("url")).alias("host"))
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    names = pages.select("host").distinct()
    index = names.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.collect_list("host"), lambda h: F.concat(F.lit("<sitemap><loc>"), h, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml")).select(F.lit("root").alias("url"), "xml")
    hosts = names.select(F.col("host").alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), "host", F.lit("/pages</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>")).alias("xml"))
    own = pages.groupBy("host").agg(F.array_join(F.transform(F.collect_list(escaped), lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))), "").alias("body")).select(F.concat("host", F.lit("/pages")).alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))
    return files.sitemap_pages(spark.createDataFrame([("root",)], "url string"), index.unionByName(hosts).unionByName(own), keyword="en")


@registered(
    f"""WITH p AS (SELECT DISTINCT url, {_HOST} AS host, {_PATH} AS path FROM pages), h AS (SELECT host, min(split_part(path, '/', 2)) AS part FROM p GROUP BY 1)
    SELECT url, NOT starts_with(path, '/' || part || '/') OR ends_with(path, '7') AS allowed FROM p JOIN h USING (host)"""
)
def urls_allowed_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that their own hosts' rules allow: each shuts one part of its site, but for addresses whose path ends with a 7.
    Rules fit paths with their queries: the addresses are asked about without them."""
    bare = F.regexp_extract(F.trim("url"), r"^[^?#]*", 0)
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("url", U.hostname(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"), bare.alias("bare")).distinct()
    part = pages.groupBy("host").agg(F.min(F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))).alias("part"))
    body = F.concat(F.lit("# rules\nUser-agent: x\nUser-agent: *\nDisallow: /"), "part", F.lit("/\nAllow: /"), "part", F.lit("/*7$\nUser-agent: y\nDisallow: /\n"))
    judged = files.allowed(part.select("host", body.alias("body")), pages.select(F.col("bare").alias("url")).distinct())
    return pages.join(judged.withColumnRenamed("url", "bare"), "bare").select("url", "allowed")


#: field -> the value as JSON that a part has for it.
_VALUES = {
    "price": """'{"amount":"$ 1,' || (p_size + 100) || '.50"}'""", "original_price": """'"-$ ' || p_size || '"'""", "currency": """'{"priceCurrency":"eur"}'""", "brand": """'{"@type":"Brand","name":" ' || p_brand || ' "}'""", "category": """'"/c/' || p_partkey || '"'""",
    "title": """p_name || ' &amp; more'""", "review_count": """'{"reviewCount":"' || p_size || ',000"}'""", "rating": """'{"ratingValue":4.126}'""", "availability": """CASE WHEN p_size > 25 THEN '"https://schema.org/InStock"' ELSE 'false' END""", "url": """'"p/' || p_partkey || '?q=1"'""",
    "tags": """'["' || p_type || ', x",{"name":"X"},["y"],"' || p_brand || '"]'""", "description": """'"<p>' || p_name || '</p> <b>bold</b>"'""", "color": """'[null,{},{"label":"red"},"blue"]'""", "barcode": """'["' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '"]'""", "remote": """'true'""", "other": """p_size || ''""",
}


@registered(
    """SELECT p_partkey, field, kind, value FROM part, LATERAL (VALUES ('price', 'price', '1' || (p_size + 100) || '.50'), ('currency', 'currency', 'EUR'), ('brand', 'name', p_brand), ('title', 'name', p_name || ' & more'), ('review_count', 'whole', (p_size * 1000)::VARCHAR), ('rating', 'rating', '4.13'),
      ('availability', 'availability', CASE WHEN p_size > 25 THEN 'in_stock' ELSE 'out_of_stock' END), ('url', 'url', 'https://s.com/a/p/' || p_partkey || '?q=1'), ('tags', 'texts', p_type || '|x|y|' || p_brand), ('description', 'long_text', p_name || ' bold'), ('color', 'option', 'red'),
      ('barcode', 'barcode', lpad(p_partkey::VARCHAR, 12, '0')), ('remote', 'flag', 'true'), ('other', 'text', p_size::VARCHAR)) v(field, kind, value)"""
)
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of parts' fields, given as JSON of all shapes, by the kinds of their fields."""
    pairs = F.array(*(F.struct(F.lit(name).alias("field"), F.expr(sql.replace("VARCHAR", "STRING")).alias("value")) for name, sql in _VALUES.items()))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.inline(pairs))
    return typed.coerced(rows, ["p_partkey"], F.lit("https://s.com/a/b")).select("p_partkey", "field", "kind", F.array_join("values", "|").alias("value"))


_SHOP = """'<nav><img src=/logo.png></nav><div class=gallery><img src="/' || p_partkey || '.jpg?w=90" width=90><img srcset="/' || p_partkey || '.jpg?w=900 900w" alt="' || p_name || '"></div><img src="/t.jpg"><time datetime="' || (2000 + p_size) || '-01-01">x</time><label for=c>Size</label><select id=c><option>Choose an option<option selected>' || p_size || '<option disabled>' || (p_size + 1) || '</select><p>' || p_name || '. ' || p_name || '. Prices are subject to change. By ' || p_brand || '.</p>'"""


@registered(
    """SELECT p_partkey AS page_id, part, place::INT AS place, value FROM part, LATERAL (VALUES ('image', 1, 'https://s.com/' || p_partkey || '.jpg?w=900'), ('image', 2, 'https://s.com/t.jpg'), ('date', 1, (2000 + p_size) || '-01-01'), ('size', 1, p_size || ' selected'), ('size', 2, (p_size + 1) || ' gone'), ('text', 1, p_name || '. By ' || p_brand || '.')) v(part, place, value)"""
)
def page_parts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, date, options and description of products' pages."""
    pages = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(_SHOP).alias("html"), F.lit("https://s.com/x").alias("page_url"))
    # each part reads the tree, none its pieces of text
    tree = store.kept(dom.nodes(pages, columns=["pre", "last", "tag", "attrs", "start", "end", "flow"]).where("tag <> '#text'"), "elements")
    images = page_parts.images(tree, pages.select("page_id", "page_url")).select("page_id", F.lit("image").alias("part"), "place", F.col("url").alias("value"))
    dates = page_parts.publication_date(tree).select("page_id", F.lit("date").alias("part"), F.lit(1).alias("place"), F.col("date").alias("value"))
    state = F.when(F.col("selected"), " selected").when(~F.col("available"), " gone").otherwise("")
    options = page_parts.options(tree).select("page_id", F.col("axis").alias("part"), "place", F.concat("value", state).alias("value"))
    texts = dom.below(tree.where("tag = 'p'"), tree).select("page_id", F.lit("text").alias("part"), F.lit(1).alias("place"), page_parts.long_text(F.col("below"), F.lit("")).alias("value"))
    return images.unionByName(dates).unionByName(options).unionByName(texts)


@registered(
    """SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'shop' END AS brand, CASE WHEN p_size % 2 = 0 THEN lower(replace(p_brand, '#', ' ')) ELSE 'shop' END AS normalized_brand, CAST(p_retailprice AS DOUBLE) AS price, 'EUR' AS currency, 'K' || p_partkey AS sku, 'fv' || (p_partkey + 1000) AS style_code, 'https://shop.com/' || p_partkey AS url FROM part"""
)
def product_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' records, whose fields have different names, in one shape."""
    key = F.col("p_partkey")
    record = F.create_map(*(c for k, v in {
        "name": F.col("p_name"), "vendor": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "), "price": F.concat(F.lit("€ "), F.format_string("%.2f", "p_retailprice")), "sku": F.concat(F.lit("K"), key), "mpn": F.concat(F.lit("FV"), key + 1000), "ean": F.lit("4006381333931"), "source_url": F.concat(F.lit("https://shop.com/"), key),
    }.items() for c in (F.lit(k), v)))
    s = table(spark, sf_dir, "part").select("p_partkey", snapshots.snapshot(record).alias("s"))
    return s.select("p_partkey", *(F.col(f"s.{c}").alias(c) for c in ("title", "brand", "normalized_brand", "price", "currency", "sku", "style_code", "url")))
