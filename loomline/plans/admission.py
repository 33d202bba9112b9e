"""Queries on candidates of products, variant axes, values of alert rules and scripts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as A
from .registry import registered, table

_FOUND = "CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN c.p_name || ' ZX' || (10000 + l_partkey) WHEN 3 THEN s.p_name || ' ZX' || (20000 + l_suppkey) WHEN 4 THEN s.p_name ELSE c.p_name END"
_URL = "CASE l_suppkey % 3 WHEN 0 THEN 'https://shop.example/category/' || l_suppkey WHEN 1 THEN 'https://shop.example/product/' || replace(s.p_name, ' ', '-') ELSE 'https://shop.example/' || replace(c.p_name, ' ', '-') || '-q-r-s?x=1' END"


def _list(name: str, text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS {name}"


@registered(
    rf"""WITH j AS (SELECT l_orderkey, l_linenumber, s.p_name AS title, s.p_brand AS brand, 'ZX' || (10000 + l_partkey) AS code, {_FOUND} AS found, {_URL} AS url
        FROM lineitem JOIN part s ON s.p_partkey = l_partkey JOIN part c ON c.p_partkey = l_suppkey),
      w AS (SELECT *, {_list("known", "title || ' ' || code")}, {_list("shown", "found")}, {_list("seen", "url")}, {_list("t", "title")}, {_list("o", "CASE WHEN found = '' THEN url ELSE found END")}, {_list("own", "brand")},
        regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM j),
      f AS (SELECT *, [x FOR x IN known IF length(x) >= 5 AND regexp_matches(x, '[0-9]')] AS ki, [x FOR x IN shown IF length(x) >= 5 AND regexp_matches(x, '[0-9]')] AS si,
        [x FOR x IN t IF NOT list_contains(own, x)] AS a, [x FOR x IN o IF NOT list_contains(own, x)] AS b, regexp_extract(path, '([^/]*)/*$', 1) AS last FROM w),
      d AS (SELECT *, regexp_matches(path, '{A.PRODUCT_PATHS}') OR (NOT regexp_matches(path, '{A.LISTING_PATHS}') AND (regexp_matches(last, '^[^-]+(-[^-]+){{3,}}$') OR regexp_matches(last, '^[a-z]*[0-9]{{5,}}$'))) AS detail,
        least(len(a), len(b)) AS n, len(list_intersect(a, b)) AS n_both FROM f)
    SELECT l_orderkey, l_linenumber, detail AND (list_has_any(ki, si || seen) OR (NOT (len(ki) > 0 AND len(si) > 0) AND NOT (n >= {A.LEAST_TOKENS} AND n_both < {A.LEAST_OVERLAP} * n))) AS admitted FROM d"""
)
def candidate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of parts, found under product, listing and other paths, with the same, another or no code."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    met = items.join(parts.alias("s"), F.col("s.p_partkey") == F.col("l_partkey")).join(parts.alias("c"), F.col("c.p_partkey") == F.col("l_suppkey"))
    met = met.select("l_orderkey", "l_linenumber", F.col("s.p_name").alias("title"), F.col("s.p_brand").alias("brand"), F.expr("'ZX' || (10000 + l_partkey)").alias("code"), F.expr(_FOUND).alias("found"), F.expr(_URL).alias("url"))
    return met.select("l_orderkey", "l_linenumber", A.admitted(*(F.col(c) for c in ("title", "brand", "code", "url", "found"))).alias("admitted"))


_AXIS = "CASE p_size % 7 WHEN 0 THEN 'Color' WHEN 1 THEN 'Select & Size' WHEN 2 THEN 'Shoe size 2' WHEN 3 THEN ' Colour ' WHEN 4 THEN 'Pack-Count' WHEN 5 THEN 'Size / Color' ELSE p_brand END"
_VALUE = "CASE p_partkey % 7 WHEN 0 THEN '#fFf' WHEN 1 THEN 'Save 20%' WHEN 2 THEN '  ' WHEN 3 THEN 'Choose an option' WHEN 4 THEN '50% cotton' WHEN 5 THEN '#12345' ELSE p_type END"
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)


@registered(
    rf"""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower({_AXIS}), '[^a-z0-9]+', '_', 'g'), '_') AS k, lower(trim({_VALUE})) AS v FROM part),
      a AS (SELECT p_partkey, v, CASE k {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in A.AXIS_ALIASES.items())} ELSE k END AS k FROM s),
      w AS (SELECT *, [x FOR x IN string_split(k, '_') IF x IN ({_quoted(A.AXES)}) OR NOT (x IN ({_quoted(A.AXIS_FILLERS)}) OR regexp_matches(x, '^[0-9]*$') OR length(x) <= 3)] AS t FROM a)
    SELECT p_partkey, CASE WHEN len(t) = 1 AND t[1] IN ({_quoted(A.AXES)}) THEN t[1] ELSE k END AS axis,
      v = '' OR regexp_matches(v, '^#([0-9a-f]{{3}}|[0-9a-f]{{6}})$') OR (contains(v, '%') AND regexp_matches(v, '{"|".join(A.PROMO_WORDS)}')) OR v IN ({_quoted(A.NOISE_VALUES)}) AS noise FROM w"""
)
def variant_axis_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes and values of parts as shops write them: the axis's key, and whether the value is none."""
    return table(spark, sf_dir, "part").select("p_partkey", A.axis_key(F.expr(_AXIS)).alias("axis"), A.option_noise(F.expr(_VALUE)).alias("noise"))


@registered("SELECT o_orderkey, 'Priority=' || o_orderpriority || ',rule_3=' || o_custkey || CASE WHEN o_orderstatus <> 'F' THEN ',status=' || o_orderstatus ELSE '' END AS tracked FROM orders")
def alert_rule_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of four alert rules by label, path and number; two share a key, values that are null are left out of the line."""
    status = F.expr("CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END")
    rules = [(" Priority ", "priority", F.col("o_orderpriority")), ("status", "old", F.lit("old")), ("", " ", F.col("o_custkey")), (None, "status", status)]
    values = F.filter(F.map_entries(A.rule_values(rules)), lambda e: e["value"].isNotNull())
    line = F.array_join(F.array_sort(F.transform(values, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("tracked"))


_HTML = """CASE page_id % 3 WHEN 0 THEN replace(html, '<script>', '<script type="application/json" id=" state "> ') WHEN 1 THEN replace(html, '<script>', '<template data-varname="page"> <script>') ELSE replace(html, '</body>', '<script src="a.js"></script></body>') END"""


@registered(
    rf"""WITH s AS (SELECT page_id, unnest(regexp_extract_all({_HTML}, '(?is)(?:<template\b[^>]*>\s*)?<script\b[^>]*>.*?</script\s*>')) AS found FROM pages),
      t AS (SELECT page_id, regexp_extract(found, '(?is)^(<template\b[^>]*>)', 1) AS template, regexp_extract(found, '(?is)(<script\b[^>]*>)', 1) AS tag, trim(regexp_extract(found, '(?is)<script\b[^>]*>(.*)</script\s*>$', 1)) AS text FROM s),
      n AS (SELECT page_id, text, trim(regexp_extract(tag, '(?is)\sid\s*=\s*["'']([^"'']*)["'']', 1)) AS id, trim(regexp_extract(tag, '(?is)\stype\s*=\s*["'']([^"'']*)["'']', 1)) AS type,
        trim(regexp_extract(template, '(?is)\sdata-(?:varname|state|id)\s*=\s*["'']([^"'']*)["'']', 1)) AS outer_id FROM t)
    SELECT page_id, CASE WHEN id = '' THEN outer_id ELSE id END AS script_id, type AS script_type, text FROM n WHERE text <> ''"""
)
def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts with a text of each page, with their ids and types."""
    nodes = table(spark, sf_dir, "pages").select("page_id", F.explode(A.script_texts(F.expr(_HTML))).alias("s"))
    return nodes.select("page_id", F.col("s.id").alias("script_id"), F.col("s.type").alias("script_type"), F.col("s.text").alias("text"))
