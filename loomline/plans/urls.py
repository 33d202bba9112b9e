"""Queries over the URLs of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from .registry import registered, table

_NETLOC = r"regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)', 1)"
_DOMAIN = rf"regexp_replace(regexp_replace({_NETLOC}, ':(80|443)$', ''), '^www\.', '')"
_HOST = rf"regexp_replace({_NETLOC}, ':[0-9]+$', '')"
_PATH = r"regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1)"
_BASE = r"regexp_extract(trim(url), '^([^?#]*)', 1)"
_PARAMS = f"list_filter(string_split({_QUERY}, '&'), lambda p: p <> '')"
_NAME = "lower(regexp_extract(p, '^([^=]*)', 1))"


@registered(f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, min(page_id) LIMIT 5")
def url_domain_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "pages").groupBy(U.domain_key(F.col("url")).alias("domain")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(5).select("domain", "n")


_MONITOR_KEY = rf"""lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || {_NETLOC} ||
  CASE WHEN {_PATH} = '/' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END"""


@registered(
    f"""WITH k AS (SELECT page_id, url, {_MONITOR_KEY} AS monitor_key FROM pages)
    SELECT monitor_key, sha256(trim(url)) AS identity_key, page_id FROM k
    QUALIFY row_number() OVER (PARTITION BY monitor_key ORDER BY length(url), page_id) = 1"""
)
def url_identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a monitor key: the shortest URL, the least id of equals."""
    keyed = table(spark, sf_dir, "pages").select("page_id", "url", U.monitor_key(F.col("url")).alias("monitor_key"))
    best = keyed.groupBy("monitor_key").agg(F.min(F.struct(F.length("url").alias("l"), "page_id", "url")).alias("b"))
    return best.select("monitor_key", U.identity_key(F.col("b.url")).alias("identity_key"), F.col("b.page_id").alias("page_id"))


_TRACKED = "'" + "','".join(U.TRACKING_PARAMS) + "'"
_KEPT = f"list_filter({_PARAMS}, lambda p: NOT starts_with({_NAME}, 'utm_') AND {_NAME} NOT IN ({_TRACKED}))"


@registered(f"SELECT page_id, CASE WHEN len({_KEPT}) > 0 THEN {_BASE} || '?' || array_to_string({_KEPT}, '&') ELSE {_BASE} END AS stripped FROM pages")
def url_strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.strip_tracking(F.col("url")).alias("stripped"))


_VOLATILE = "'" + "','".join(U.VOLATILE_PARAMS) + "'"
_STABLE = f"list_sort(list_filter({_PARAMS}, lambda p: {_NAME} NOT IN ({_VOLATILE}) AND NOT starts_with({_NAME}, 'utm_')))"
_COLLAPSED = f"{_DOMAIN} || regexp_replace({_PATH}, '/+$', '') || CASE WHEN len({_STABLE}) > 0 THEN '?' || array_to_string({_STABLE}, '&') ELSE '' END"


@registered(f"SELECT {_COLLAPSED} AS offer_key, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_offer_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(U.collapse_key(F.col("url")).alias("offer_key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda p: p <> '')"
_SHAPE = f"lower(coalesce({_PARTS}[1], '')) || '|' || CASE WHEN regexp_matches({_PATH}, '[0-9]') THEN 'id' ELSE '-' END || '|' || least(len({_PARTS}), 4)::VARCHAR"


@registered(
    f"""WITH s AS (SELECT {_HOST} AS host, {_SHAPE} AS signature, count(*) AS n FROM pages GROUP BY 1, 2)
    SELECT host, max(n)::BIGINT AS largest, sum(n)::BIGINT AS pages, max(n) / sum(n) AS homogeneity FROM s GROUP BY host"""
)
def url_shape_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each host's pages that have its most frequent URL shape."""
    shapes = table(spark, sf_dir, "pages").groupBy(U.hostname(F.col("url")).alias("host"), U.shape_signature(F.col("url")).alias("signature")).count()
    return shapes.groupBy("host").agg(F.max("count").alias("largest"), F.sum("count").alias("pages")).withColumn("homogeneity", F.col("largest") / F.col("pages"))


_P = f"lower({_PATH})"
_RULE_SQL = {"path": _P, "host": _HOST}


def _surface_sql(value) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({_RULE_SQL[where]}, '{pattern}') THEN {value(kind, sure)}" for kind, sure, where, pattern in U.SURFACE_RULES)


@registered(
    f"""SELECT page_id, {_surface_sql(lambda k, c: f"'{k}'")} ELSE 'content_detail' END AS surface,
    CAST({_surface_sql(lambda k, c: str(c))} ELSE 0.4 END AS DOUBLE) AS confidence FROM pages"""
)
def surface_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, sure = U.surface(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("surface"), sure.alias("confidence"))


@registered("SELECT page_id, url FROM pages WHERE contains(lower(url), 'en') ORDER BY page_id LIMIT 50")
def sitemap_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.lower("url").contains("en")).orderBy("page_id").limit(50).select("page_id", "url")


_SUFFIXES = "'" + "','".join(U.TWO_LABEL_SUFFIXES) + "'"
_H = f"string_split({_HOST}, '.')"


@registered(
    f"""SELECT CASE WHEN len({_H}) <= 2 THEN {_HOST} WHEN array_to_string({_H}[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string({_H}[-3:], '.')
      ELSE array_to_string({_H}[-2:], '.') END AS site, count(*) AS n, count(DISTINCT {_HOST}) AS hosts FROM pages GROUP BY 1"""
)
def url_registrable_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(U.registrable_host(F.col("url")).alias("site")).agg(F.count("*").alias("n"), F.count_distinct(U.hostname(F.col("url"))).alias("hosts"))


@registered(
    f"""WITH d AS (SELECT page_id, url, {_DOMAIN} AS domain FROM pages), r AS (
      SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS place FROM d)
    SELECT page_id, domain, place FROM r WHERE place <= 25"""
)
def domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 25 pages a domain, in order of id."""
    pages = table(spark, sf_dir, "pages").select("page_id", U.domain_key(F.col("url")).alias("domain"))
    return pages.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("page_id")).cast("long")).where("place <= 25")


@registered(
    rf"""SELECT page_id, regexp_matches(url, '^https?://[^/\s]+') AND length(url) <= 2048 AND NOT regexp_matches(lower(url), 'javascript:|/logout|/signout') AS safe,
    len(regexp_extract_all(url, 'https?://')) > 1 AS concatenated FROM pages"""
)
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.navigation_safe(F.col("url")).alias("safe"), U.is_concatenated(F.col("url")).alias("concatenated"))
