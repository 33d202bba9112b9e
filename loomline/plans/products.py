"""Queries over products: parts stand for them, their line items for variants. Payloads are made of the rows and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import money, text
from ..functions import url as U
from ..operators import enrichment, export, extraction, linkage, products, variants
from ..sources import files, html
from .linkage import TAXONOMY, _TAXONOMY
from .registry import registered, table
from .urls import _HOST, _NETLOC


@registered(
    """WITH c AS (SELECT DISTINCT l_orderkey AS a, l_partkey // 4 AS code FROM lineitem)
      SELECT x.a AS a, y.a AS b, count(*) AS shared FROM c x JOIN c y ON x.code = y.code AND x.a < y.a GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def shared_style_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share two style codes of their parts or more. A code is that of a few parts."""
    # the lines travel as two numbers, not as sets of one code each
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("l_partkey div 4").alias("code")).repartition("l_orderkey")
    return products.shared_codes(lines.groupBy("l_orderkey").agg(F.collect_set("code").alias("codes")), "l_orderkey", F.col("codes"), least=2)


_GTIN = "CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '0') ELSE '' END"
_SITE = "CASE WHEN p_size % 3 = 0 THEN 'brand.example.com' ELSE '' END"
_MAKER = "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(p_brand) END"


@registered(
    f"""WITH p AS (SELECT p_partkey, {_MAKER} AS b, p_name AS t, {_GTIN} AS g, 'M' || p_partkey AS m, {_SITE} AS s FROM part), q AS (SELECT *, CASE WHEN g <> '' THEN g ELSE m END AS c FROM p)
      SELECT p_partkey, list_distinct_ordered AS queries FROM (SELECT p_partkey, list_filter([CASE WHEN g <> '' THEN '"' || g || '"' END, CASE WHEN b <> '' AND s <> '' THEN 'site:' || s || ' "' || c || '"' END,
        CASE WHEN b <> '' AND s <> '' THEN 'site:' || s || ' ' || b || ' ' || t END, CASE WHEN b <> '' THEN b || ' ' || t || ' "' || c || '"' END, CASE WHEN b <> '' THEN b || ' ' || t END,
        CASE WHEN b = '' THEN '"' || t || '" "' || c || '"' END, CASE WHEN b = '' THEN '"' || t || '" buy' END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM q)"""
)
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda sql: F.expr(sql.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "part").select("p_partkey", products.search_queries(said(_MAKER), F.col("p_name"), said(_GTIN), F.concat(F.lit("M"), "p_partkey"), said(_SITE)).alias("queries"))


@registered("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE replace(p_brand, '#', ' ') END AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'marker' WHEN p_partkey % 3 = 1 THEN 'url' ELSE 'none' END AS basis FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT p_partkey, NULL, 'none' FROM part WHERE p_partkey % 3 = 2")
def brands_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand from the mark in a title, else from the URL's path, else none."""
    key = F.col("p_partkey")
    title = F.when(key % 3 == 0, F.concat("p_name", F.lit(" by "), "p_brand")).otherwise(F.col("p_name"))
    url = F.when(key % 3 == 1, F.concat(F.lit("https://shop.example.com/brand/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/item"))).otherwise("https://shop.example.com/item")
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), url.alias("url"))
    marked = F.nullif(F.regexp_extract("title", r" by ([A-Z][\w# -]*)$", 1), F.lit(""))
    pathed = F.nullif(F.regexp_extract(U.path(F.col("url")), r"/brands?/([^/]+)", 1), F.lit(""))
    return rows.select("p_partkey", F.coalesce(marked, V.title_case(F.replace(pathed, F.lit("-"), F.lit(" ")))).alias("brand"), F.when(marked.isNotNull(), "marker").when(pathed.isNotNull(), "url").otherwise("none").alias("basis"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their variants: id, sku, options, price and stock, in order of their line items."""
    options = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    sku = F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("S"), "l_suppkey"))
    variant = F.struct(F.lit("").alias("id"), sku.alias("sku"), options.alias("options"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("long")).alias("stock"))
    order = F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").cast("decimal(18,2)").alias("e"), variant.alias("v"))
    # maps cannot be sorted: the order stands before them and decides
    listed = F.array_sort(F.collect_list(order), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).when(a["e"] < b["e"], -1).when(a["e"] > b["e"], 1).otherwise(0))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.transform(listed, lambda x: x["v"]).alias("variants"))


_SKU = "CASE WHEN l_suppkey % 4 = 0 THEN 'options:flag=' || lower(l_returnflag) || '|status=' || lower(l_linestatus) ELSE 'sku:S' || l_suppkey END"


@registered(f"SELECT l_partkey, {_SKU} AS identity, max(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END)::INT AS has_stock FROM lineitem GROUP BY 1, 2")
def variants_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = variants.merged(_lines(spark, sf_dir), "l_partkey")
    return merged.select("l_partkey", "identity", F.when(F.col("stock").isNotNull(), 1).otherwise(0).alias("has_stock"))


@registered("SELECT l_partkey, axis, list_sort(list(DISTINCT v)) AS values FROM (SELECT l_partkey, 'flag' AS axis, l_returnflag AS v FROM lineitem UNION ALL SELECT l_partkey, 'status', l_linestatus FROM lineitem) GROUP BY 1, 2")
def variant_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.axes(_lines(spark, sf_dir), "l_partkey").select("l_partkey", "axis", F.array_sort("values").alias("values"))


@registered("SELECT l_partkey, least(count(*) FILTER (l_suppkey % 4 <> 0 OR l_quantity > 10), 5)::INT AS n FROM lineitem GROUP BY 1")
def variants_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many variants of each part the public form has: those with a sku or stock, five at most."""
    return _lines(spark, sf_dir).select("l_partkey", F.size(products.public_variants(F.col("variants"), ["sku", "stock"], 5)).alias("n"))


@registered("SELECT l_partkey, count(*) >= 2 AND count(l_suppkey) FILTER (l_suppkey % 4 <> 0) = count(DISTINCT l_suppkey) FILTER (l_suppkey % 4 <> 0) AS valid FROM lineitem GROUP BY 1")
def variant_groups_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_partkey", products.valid_group(F.col("variants")).alias("valid"))


@registered(
    """SELECT l_suppkey, len(list_intersect(f, r)) >= 0.8 * least(len(f), len(r)) AS one_axis FROM (SELECT l_suppkey, list(DISTINCT l_returnflag) AS f, list(DISTINCT CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'n' END) AS x, list(DISTINCT upper(CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'n' END)) AS r FROM lineitem GROUP BY 1)"""
)
def axes_mislabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers two of whose axes carry the same values."""
    other = F.when(F.col("l_linestatus") == "F", " a ").otherwise("n")
    sets = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set(other).alias("r"))
    return sets.select("l_suppkey", products.mislabelled(F.col("f"), F.col("r")).alias("one_axis"))


@registered("SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = CASE WHEN p_size % 2 = 0 THEN 'R' ELSE 'N' END GROUP BY 1")
def variant_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that a URL's parameters select, the first of those that fit."""
    url = F.concat(F.lit("https://shop.example.com/p?utm_source=x&Flag="), F.when(F.col("p_size") % 2 == 0, "r").otherwise("n"))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_extract(U.query(url), r"(?i)(?:^|&)flag=([^&]*)", 1)).alias("flag"))
    met = table(spark, sf_dir, "lineitem").join(pages, (F.col("l_partkey") == F.col("p_partkey")) & (F.lower("l_returnflag") == F.col("flag")))
    return met.groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_order"))


@registered("SELECT l_suppkey, l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def variant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of a supplier's axes that have a real row: all combinations of its values, met with the rows."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    axes = rows.groupBy("l_suppkey").agg(F.collect_set("flag").alias("flags"), F.collect_set("status").alias("statuses"))
    grid = axes.select("l_suppkey", F.explode("flags").alias("flag"), "statuses").select("l_suppkey", "flag", F.explode("statuses").alias("status"))
    return grid.join(rows, ["l_suppkey", "flag", "status"])


@registered(
    f"""WITH c AS (SELECT col0 AS category, string_split(lower(col0), ' > ') AS parts FROM (VALUES {_TAXONOMY}) v), i AS (SELECT category, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM c),
      m AS (SELECT p_partkey, category, n, max(CASE WHEN place = n THEN 1.3 ELSE 0.87 END)::DOUBLE AS score FROM part JOIN i ON contains(' ' || lower(p_name) || ' ', ' ' || part || ' ') GROUP BY 1, 2, 3)
      SELECT p_partkey, category, score FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, n, category) = 1"""
)
def phrase_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.phrase_categories(table(spark, sf_dir, "part"), "p_partkey", "p_name", spark.createDataFrame([(c,) for c in TAXONOMY], "category string"))


#: Our own defaults: words that rule a branch of the taxonomy out.
CONFLICTS = [("ring", "Tools"), ("gear", "Jewellery"), ("bolt", "Jewellery")]
_VETOES = ", ".join(f"('{w}', '{b}')" for w, b in CONFLICTS)


@registered(f"""SELECT DISTINCT p_partkey, branch FROM part JOIN (VALUES {_VETOES}) x(word, branch) ON contains(' ' || lower(p_name) || ' ', ' ' || word || ' ')""")
def branches_ruled_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of the taxonomy that a word of a part's title rules out."""
    return enrichment.ruled_out(table(spark, sf_dir, "part"), "p_partkey", "p_name", spark.createDataFrame(CONFLICTS, "word string, branch string"))


_SCORES = f"""c AS (SELECT col0 AS category, string_split(lower(col0), ' > ') AS parts, list_distinct(list_filter(regexp_split_to_array(lower(col0), '[^a-z0-9]+'), lambda t: len(t) > 1)) AS tokens FROM (VALUES {_TAXONOMY}) v),
      phrase AS (SELECT p_partkey, category, max(CASE WHEN place = n THEN 1.3 ELSE 0.87 END)::DOUBLE AS score FROM part JOIN (SELECT category, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM c) i ON contains(' ' || lower(p_name) || ' ', ' ' || part || ' ') GROUP BY 1, 2),
      token AS (SELECT p_partkey, category, count(*) / n AS score FROM (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS token FROM part) p JOIN (SELECT category, len(tokens) AS n, unnest(tokens) AS token FROM c) i USING (token) GROUP BY p_partkey, category, n),
      best AS (SELECT p_partkey, category, score FROM (SELECT p_partkey, category, max(score) AS score FROM (SELECT * FROM phrase UNION ALL SELECT * FROM token WHERE score >= 0.42) GROUP BY 1, 2) s JOIN part USING (p_partkey)
        WHERE NOT EXISTS (SELECT 1 FROM (VALUES {_VETOES}) x(word, branch) WHERE contains(' ' || lower(p_name) || ' ', ' ' || word || ' ') AND starts_with(category, branch || ' > '))
        QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, len(string_split(category, ' > ')), category) = 1)"""


@registered(f"WITH {_SCORES} SELECT p_partkey, category, score FROM best")
def categories_without_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best category of each part that no word of its title rules out."""
    tree, conflicts = spark.createDataFrame([(c,) for c in TAXONOMY], "category string"), spark.createDataFrame(CONFLICTS, "word string, branch string")
    return enrichment.categories(table(spark, sf_dir, "part"), "p_partkey", "p_name", tree, conflicts)


#: Our own defaults: terms of attributes' values.
VOCABULARY = {"colour": {"red": ["red", "crimson"], "blue": ["blue", "navy"], "green": ["green"]}, "girth": {"small": ["small", "mini"], "large": ["large", "big"]}}


def _term(name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(p_name || ' ' || lower(p_type), '(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)') THEN '{value}'" for value, terms in VOCABULARY[name].items()) + " END"


@registered(
    f"""WITH {_SCORES}, a AS (SELECT *, {_term("colour")} AS colour, {_term("girth")} AS girth FROM part)
    SELECT p_partkey, category, score, concat_ws(',', 'colour=' || colour, 'girth=' || girth) AS attributes, concat_ws(',', CASE WHEN colour IS NULL THEN 'colour' END, CASE WHEN girth IS NULL THEN 'girth' END) AS missing,
      CASE WHEN p_size >= 40 THEN 'XL' ELSE p_size::VARCHAR END AS size, CASE WHEN p_size >= 40 THEN 'alpha' WHEN p_retailprice < 1000 THEN 'eu' ELSE 'us' END AS size_system, 'cotton,' || lower(p_type) AS materials,
      concat_ws(',', 'brand:' || lower(p_brand), CASE WHEN p_retailprice < 1000 THEN 'budget' END, 'colour:' || colour, 'girth:' || girth) AS tags
    FROM a LEFT JOIN best USING (p_partkey)"""
)
def enriched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole enrichment of each part; its description states a size, a system and materials in words."""
    size = F.when(F.col("p_size") >= 40, "Size: XL").when(F.col("p_retailprice") < 1000, F.concat(F.lit("in EU "), "p_size")).otherwise(F.concat(F.lit("comes in size US "), "p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.concat(size, F.lit(", 60% cotton and 40 % "), "p_type").alias("description"), "p_retailprice")
    tree, conflicts = spark.createDataFrame([(c,) for c in TAXONOMY], "category string"), spark.createDataFrame(CONFLICTS, "word string, branch string")
    done = enrichment.projection(rows, "p_partkey", tree, conflicts, VOCABULARY, [("budget", F.col("p_retailprice") < 1000)], ["and", "the"])
    said = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return done.select("p_partkey", "category", "score", said.alias("attributes"), F.array_join("missing", ",").alias("missing"), "size", "size_system", F.array_join("materials", ",").alias("materials"), F.array_join("tags", ",").alias("tags"))


@registered("SELECT category, sum(has_size) AS with_size, sum(has_colour) AS with_colour, count(*) AS n FROM (SELECT split_part(p_type, ' ', 1) AS category, regexp_matches(lower(p_name), '(^| )(small|large)( |$)')::INT AS has_size, regexp_matches(lower(p_name), '(^| )(red|blue|green)( |$)')::INT AS has_colour FROM part) GROUP BY 1")
def attribute_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attributes the titles of a category state."""
    states = lambda *terms: F.when(F.lower("p_name").rlike("(^| )(" + "|".join(terms) + ")( |$)"), 1).otherwise(0)
    return table(spark, sf_dir, "part").groupBy(F.split("p_type", " ")[0].alias("category")).agg(F.sum(states("small", "large")).cast("decimal(38,0)").alias("with_size"), F.sum(states("red", "blue", "green")).cast("decimal(38,0)").alias("with_colour"), F.count("*").alias("n"))


@registered("SELECT p_partkey, list_sort(list_distinct(list_filter([CASE WHEN p_retailprice < 1000 THEN 'budget' END, CASE WHEN p_size >= 40 THEN 'oversize' END, 'brand:' || lower(p_brand)], lambda t: t IS NOT NULL))) AS tags FROM part")
def discovery_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.when(F.col("p_retailprice") < 1000, "budget"), F.when(F.col("p_size") >= 40, "oversize"), F.concat(F.lit("brand:"), F.lower("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(F.array_compact(tags))).alias("tags"))


@registered("SELECT system, size, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'eu' WHEN 1 THEN 'us' ELSE 'alpha' END AS system, CASE p_size % 3 WHEN 2 THEN 'XL' ELSE p_size::VARCHAR END AS size FROM part) GROUP BY 1, 2")
def sizes_and_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes out of texts, and the system that they are told in."""
    n = F.col("p_size")
    said = F.when(n % 3 == 0, F.concat(F.lit("Size EU "), n)).when(n % 3 == 1, F.concat(F.lit("US size: "), n)).otherwise(F.lit("size xl"))
    rows = table(spark, sf_dir, "part").select(said.alias("t"))
    return rows.groupBy(enrichment.size_system(F.col("t")).alias("system"), enrichment.size_of(F.col("t")).alias("size")).agg(F.count("*").alias("n"))


# --- payloads of pages -------------------------------------------------------------------------------------------

_ROW = "'\"name\":\"' || p_name || '\",\"sku\":\"K' || CAST(p_partkey AS VARCHAR) || '\"'"


def _pages(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(sql.replace("VARCHAR", "STRING")).alias("html"), "p_name", "p_brand", "p_size")


@registered("SELECT p_partkey AS page_id, p_name AS name, 'K' || p_partkey AS sku, p_brand AS brand FROM part")
def jsonld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of JSON-LD graphs, their brand by reference."""
    pages = _pages(spark, sf_dir, f"'<script type=\"application/ld+json\">{{\"@graph\":[{{\"@type\":\"Product\",' || {_ROW} || ',\"brand\":{{\"@id\":\"#b\"}}}},{{\"@id\":\"#b\",\"@type\":\"Brand\",\"title\":\"' || p_brand || '\"}}]}}</script>'")
    at = lambda path: F.get_json_object("payload", path)
    return html.structured(pages).where(at("$['@type']") == "Product").select("page_id", at("$.name").alias("name"), at("$.sku").alias("sku"), at("$.brand.title").alias("brand"))


@registered("SELECT p_partkey AS page_id, p_name AS title, p_brand AS site FROM part")
def open_graph_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, "'<meta property=\"og:title\" content=\"' || p_name || '\"><meta name=\"twitter:site\" content=\"' || p_brand || '\"><meta property=\"og:image\" content=\"\">'")
    got = lambda key: F.try_element_at("meta", F.lit(key))
    return html.open_graph(pages).select("page_id", got("og:title").alias("title"), got("twitter:site").alias("site"))


@registered("SELECT p_partkey AS page_id, v.n::INT AS row, CASE v.n WHEN 1 THEN p_brand WHEN 2 THEN p_size::VARCHAR ELSE p_name END AS value FROM part, (VALUES (1), (2), (3)) v(n)")
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables of pages, counted from one; tables without a head or with few rows are passed over."""
    pages = _pages(spark, sf_dir, "'<table><tr><td>x</td></tr></table><table><tr><th>Key<th>Value</tr><tr><td>Brand</td><td>' || p_brand || '</td></tr><tr><td>Size<td>' || CAST(p_size AS VARCHAR) || '</tr><tr><td>Name</td><td> ' || p_name || '</td></tr></table>'")
    return html.table_rows(pages).select("page_id", "row", F.try_element_at("cells", F.lit("Value")).alias("value"))


@registered("SELECT p_partkey AS page_id, p_name AS name, p_size::VARCHAR AS price FROM part")
def microdata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of microdata: a property's content attribute, else its text."""
    pages = _pages(spark, sf_dir, "'<div itemscope itemtype=\"https://schema.org/Product\"><h2 itemprop=\"name\"> ' || p_name || '</h2><meta itemprop=\"price\" content=\"' || CAST(p_size AS VARCHAR) || '\"></div>'")
    props = html.microdata(pages)
    return props.groupBy("page_id").agg(F.max(F.when(F.col("property") == "name", F.col("value"))).alias("name"), F.max(F.when(F.col("property") == "price", F.col("value"))).alias("price"))


@registered("SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN 'script' ELSE 'state' END AS kind, p_name AS name, p_brand AS brand FROM part")
def embedded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in scripts, and JSON that scripts assign to a state, whose end is where its braces balance."""
    body = "'{\"product\":{' || " + _ROW + " || ',\"note\":\"a } brace\"},\"brand\":\"' || p_brand || '\"}'"
    script, state = "'<script type=\"application/json\" id=\"d\">'", "'<script>var x = 1; window.__STATE__ = '"
    pages = _pages(spark, sf_dir, f"CASE WHEN p_size % 2 = 0 THEN {script} || {body} || '</script>' ELSE {state} || {body} || '; var y = {{}};</script>' END")
    at = lambda path: F.get_json_object("payload", path)
    return html.embedded(pages).select("page_id", "kind", at("$.product.name").alias("name"), at("$.brand").alias("brand"))


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /article # but\nDisallow:"


@registered(f"SELECT DISTINCT url, NOT starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/a') OR starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/article') AS allowed FROM pages")
def urls_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that their hosts' rules allow."""
    pages = table(spark, sf_dir, "pages").select("url").distinct()
    robots = pages.select(U.hostname(F.col("url")).alias("host")).distinct().withColumn("body", F.lit(_ROBOTS))
    return files.allowed(robots, pages)


@registered("SELECT p_partkey AS source_url, p_name AS title, 'u' || p_partkey AS url FROM part UNION ALL SELECT p_partkey, 'x', NULL FROM part WHERE p_size % 2 = 0")
def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of raw JSON bodies: a list under a name, or an object alone."""
    row = "'{\"title\":\"' || p_name || '\",\"url\":\"u' || CAST(p_partkey AS STRING) || '\"}'"
    body = F.expr(f"CASE WHEN p_size % 2 = 0 THEN ' {{\"items\":[' || {row} || ',' || {row} || ',{{\"title\":\"x\"}}]}}' ELSE {row} END")
    bodies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), body.alias("body"))
    return files.json_records(bodies, ["title", "url"])


# --- functions of text and URLs ----------------------------------------------------------------------------------


@registered("SELECT p_partkey, lower(split_part(p_brand, '#', 1)) || ' ' || split_part(p_brand, '#', 2) AS brand, 'p_name_' || p_size AS field, regexp_matches(lower(p_name), '(^|[^a-z0-9])ring([^a-z0-9]|$)') AS ring, CAST(p_size + 1000 AS DOUBLE) + 0.125 AS lenient FROM part")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.brand(F.regexp_replace("p_brand", "#", " # ")).alias("brand"), text.field_key(F.concat(F.lit(" pName-"), n)).alias("field"),
        text.has_term(F.col("p_name"), "ring").alias("ring"), money.lenient_float(F.concat(F.lit("EUR "), (n + 1000).cast("string"), F.lit(",125"))).alias("lenient"),
    )


_WORD = "regexp_extract_all(lower(text), '[a-z]{4,}')"


@registered(
    f"""WITH w AS (SELECT unnest({_WORD}) AS w FROM documents), c AS (SELECT w, CASE WHEN ends_with(w, 'ing') AND len(w) > 6 THEN w[:-4] WHEN ends_with(w, 'ers') AND len(w) > 6 THEN w[:-4] WHEN ends_with(w, 'er') AND len(w) > 5 THEN w[:-3] WHEN ends_with(w, 'ed') AND len(w) > 5 THEN w[:-3] END AS cut FROM w)
    SELECT CASE WHEN cut IS NULL THEN w WHEN cut[-1] = cut[-2] THEN cut[:-2] ELSE cut END AS stem, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 20"""
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the documents' words, those that occur twenty times."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).groupBy(text.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n")).where("n >= 20")


@registered("SELECT p_partkey, p_size % 2 = 0 AS mismatch FROM part")
def spec_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose stated capacity or count differs from their pair's."""
    other = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" 64GB 3-in-1"))).otherwise(F.concat("p_name", F.lit(" 32GB")))
    return table(spark, sf_dir, "part").select("p_partkey", linkage.spec_mismatch(F.concat("p_name", F.lit(" 32gb 4-in-1")), other).alias("mismatch"))


_LAST2 = f"array_to_string(string_split({_HOST}, '.')[-2:], '.')"


@registered(f"SELECT page_id, {_LAST2} = 'example.com' AS same, contains(url, '.html') AS joined FROM pages")
def site_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are of one site with another URL, and whether two URLs stand in one."""
    url = F.when(F.col("url").contains(".html"), F.concat("url", "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.same_site(F.col("url"), F.lit("http://www.example.com/x")).alias("same"), U.is_concatenated(url).alias("joined"))


@registered("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'skipped' ELSE 'pending' END AS status FROM events WHERE event_type = 'error' AND value > 50")
def webhook_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", "field_changed").otherwise("record_new").alias("event_type"), (F.col("value") > 50).alias("condition_met"))
    return export.deliveries(events, F.when(F.col("user_id") % 3 != 0, "https://hook.example.com")).select("event_id", "status")


@registered("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['name', 'size'] ELSE ['name'] END AS keys FROM part")
def cleaned_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that leave with a record: no empty ones, no private ones."""
    data = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(""), F.lit("_source"), F.lit("dom"), F.lit("note"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.map_keys(export.cleaned(data))).alias("keys"))


@registered("WITH u AS (SELECT p_size AS k, p_name, 0 AS l, p_partkey AS ord FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_size, p_brand, 1, p_partkey FROM part WHERE p_partkey % 2 = 1), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY l, ord) = 1) SELECT k AS size, p_name AS title FROM f ORDER BY l, ord LIMIT 30")
def ranked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists one after the other, the first of a size stays, thirty at most."""
    parts = table(spark, sf_dir, "part")
    first = parts.where("p_partkey % 2 = 0").select(F.col("p_size").alias("size"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    second = parts.where("p_partkey % 2 = 1").select(F.col("p_size").alias("size"), F.col("p_brand").alias("title"), F.col("p_partkey").alias("ord"))
    return extraction.union_ranked([first, second], F.col("size"), 30).select("size", "title")


@registered("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'cloudflare' WHEN page_id % 4 = 1 THEN 'akamai' END AS vendor, CASE WHEN contains(html, 'wp-content') THEN 'wordpress' WHEN page_id % 4 = 2 THEN 'shopify' END AS family FROM pages")
def vendors_and_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who blocks, by headers, and what a site runs on, by host and markers. Our own short lists."""
    key = F.col("page_id") % 4
    headers = F.when(key == 0, F.create_map(F.lit("CF-Ray"), F.lit("1"))).when(key == 1, F.create_map(F.lit("server"), F.lit("AkamaiGHost"))).otherwise(F.create_map(F.lit("server"), F.lit("nginx")))
    low = F.transform_values(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda _, v: F.lower(v))
    vendor = F.when(F.map_contains_key(low, "cf-ray"), "cloudflare").when(F.try_element_at(low, F.lit("server")).startswith("akamai"), "akamai")
    body = F.when(key == 2, F.concat("html", F.lit("<script src=//cdn.shopify.com/x.js>"))).otherwise(F.col("html"))
    family = F.when(body.contains("wp-content"), "wordpress").when(body.contains("cdn.shopify.com"), "shopify")
    return table(spark, sf_dir, "pages").select("page_id", vendor.alias("vendor"), family.alias("family"))


@registered(f"SELECT page_id, CASE WHEN contains(lower(url), 'example') AND {_NETLOC} = '' THEN 'no host' WHEN page_id % 5 = 0 THEN 'title: site shell' WHEN page_id % 5 = 1 THEN 'url: hub' WHEN page_id % 5 = 2 THEN 'other page' END AS reason FROM pages")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a detail record is not one: its title is the site's, its URL a hub, or it tells of another page."""
    key = F.col("page_id") % 5
    title = F.when(key == 0, F.concat(F.lit(" Welcome to "), U.hostname(F.col("url")))).otherwise("A thing")
    url = F.when(key == 1, F.lit("https://a.example.com/jobs/")).otherwise(F.col("url"))
    own = F.when(key == 2, F.lit("https://b.example.com/other")).otherwise(url)
    shell = F.trim(F.lower(title)).rlike("^(welcome to|home$|log ?in)")
    hub = U.path(url).rlike("^/(jobs|careers|category|search)/?$")
    reason = F.when(shell, "title: site shell").when(hub, "url: hub").when(U.monitor_key(own) != U.monitor_key(url), "other page")
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))
