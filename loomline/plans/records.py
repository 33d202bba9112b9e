"""Queries over stored records: paging, owners, logs, prices, quality and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import listing as L
from ..operators import quality as Q
from ..sources import html as H
from .registry import registered, table


@registered("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urg') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def run_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of twenty runs of a state whose text holds a term, the latest first."""
    runs = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & F.lower("o_orderpriority").contains("urg"))
    return runs.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_orderdate", "o_totalprice")


@registered("SELECT c_mktsegment, count(*) AS records, count(DISTINCT c_custkey) AS owners, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def records_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("records"), F.count_distinct("c_custkey").alias("owners"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@registered("SELECT o_orderkey, count(l_linenumber) AS logs, min(l_linenumber) AS first_log FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 3 GROUP BY 1")
def run_with_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs after the third of each run; runs without such logs stay."""
    runs, logs = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    tail = runs.join(logs, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") > 3), "left")
    return tail.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("logs"), F.min("l_linenumber").alias("first_log"))


_SHOWN = """CASE l_orderkey % 6 WHEN 0 THEN '$' || printf('%.2f', l_extendedprice) WHEN 1 THEN 'Rs. ' || CAST(floor(l_extendedprice) AS BIGINT)
  WHEN 2 THEN replace(printf('%.2f', l_extendedprice), '.', ',') || ' €' WHEN 3 THEN '-' || printf('%.2f', l_extendedprice)
  WHEN 4 THEN 'price ' || CAST(floor(l_quantity) AS BIGINT) ELSE 'USD ' || printf('%.2f', l_extendedprice) END"""
_FOUND = r"regexp_extract(shown, '[0-9][0-9.,]*[0-9]|[0-9]', 0)"
_CANON = rf"""CASE WHEN found = '' THEN NULL WHEN regexp_matches(found, '[0-9],[0-9]{{1,2}}$') THEN regexp_replace(regexp_extract(found, '^(.*),[0-9]+$', 1), '[,.]', '', 'g') || '.' || regexp_extract(found, ',([0-9]+)$', 1)
  WHEN contains(found, ',') THEN replace(found, ',', '') WHEN regexp_matches(found, '^[0-9]+(\.[0-9]{{3}})+$') THEN replace(found, '.', '') ELSE found END"""
_MONEY = r"(?i)[$€£₹¥]|\b(rs|usd|eur|gbp|inr|jpy|cad|aud|chf|sek)\b"


@registered(
    rf"""WITH s AS (SELECT l_orderkey, l_linenumber, {_SHOWN} AS shown FROM lineitem), f AS (SELECT *, {_FOUND} AS found FROM s)
    SELECT l_orderkey, l_linenumber, shown, CASE WHEN regexp_matches(shown, '^\s*-') OR (regexp_matches(shown, '^[^0-9]*[0-9]{{1,3}}[^0-9]*$') AND NOT regexp_matches(shown, '{_MONEY}')) THEN NULL ELSE {_CANON} END AS price,
      CASE WHEN contains(shown, 'Rs.') THEN 'INR' WHEN contains(shown, '$') THEN 'USD' WHEN contains(shown, '€') THEN 'EUR' WHEN contains(shown, 'USD') THEN 'USD' END AS currency FROM f"""
)
def price_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices shown in six ways, read again."""
    items = table(spark, sf_dir, "lineitem")
    price, cents = F.col("l_extendedprice"), lambda pattern: F.format_string(pattern, F.col("l_extendedprice"))
    whole = lambda c: F.floor(c).cast("string")
    way = F.col("l_orderkey") % 6
    shown = (
        F.when(way == 0, F.concat(F.lit("$"), cents("%.2f"))).when(way == 1, F.concat(F.lit("Rs. "), whole(price))).when(way == 2, F.concat(F.regexp_replace(cents("%.2f"), r"\.", ","), F.lit(" €")))
        .when(way == 3, F.concat(F.lit("-"), cents("%.2f"))).when(way == 4, F.concat(F.lit("price "), whole(F.col("l_quantity")))).otherwise(F.concat(F.lit("USD "), cents("%.2f")))
    )
    out = items.select("l_orderkey", "l_linenumber", shown.alias("shown"))
    return out.select("*", money.price_text(F.col("shown")).alias("price"), money.currency(F.col("shown")).alias("currency"))


@registered("SELECT o_orderkey, CAST(regexp_extract('about ' || CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR || ' in all', '-?[0-9]+(?:\\.[0-9]+)?', 0) AS DECIMAL(18,4)) AS amount FROM orders")
def price_first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("about "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" in all"))
    return table(spark, sf_dir, "orders").select("o_orderkey", money.first_number(shown).alias("amount"))


@registered(
    """WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), r AS (
      SELECT 'text' AS field, avg(CASE WHEN text IS NOT NULL AND text <> '' THEN 1.0 ELSE 0.0 END) AS x FROM j UNION ALL SELECT 'lang', avg(CASE WHEN lang IS NOT NULL AND lang <> '' THEN 1.0 ELSE 0.0 END) FROM j
      UNION ALL SELECT 'quality', avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM j UNION ALL SELECT 'toxic', avg(CASE WHEN toxic IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM j)
    SELECT field, round_even(x, 4) AS rate, round_even(x, 4) >= 0.8 AS passes FROM r"""
)
def fill_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return Q.fill_rates(joined, ["text", "lang", "quality", "toxic"])


@registered(
    """WITH s AS (SELECT count(*) AS n, avg(CASE WHEN lang <> '' THEN 1.0 ELSE 0.0 END) AS c1, count(DISTINCT lower(lang)) AS d1, avg(CASE WHEN source <> '' THEN 1.0 ELSE 0.0 END) AS c2, count(DISTINCT lower(source)) AS d2 FROM documents)
    SELECT 'lang' AS field, round(0.75 * c1 + 0.25 * d1 / n, 4) AS score FROM s UNION ALL SELECT 'source', round(0.75 * c2 + 0.25 * d2 / n, 4) FROM s"""
)
def field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts coverage, one part diversity."""
    fields = ["lang", "source"]
    stats = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), *(F.avg(F.when(~text.is_empty(F.col(f)), 1.0).otherwise(0.0)).alias(f"c_{f}") for f in fields), *(F.count_distinct(F.lower(f)).alias(f"d_{f}") for f in fields))
    return stats.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.round(0.75 * F.col(f"c_{f}") + 0.25 * F.col(f"d_{f}") / F.col("n"), 4).alias("score")) for f in fields))).alias("r")).select("r.*")


_TITLE_PENALTY = "CASE WHEN length(p_name) < 4 THEN 0.35 WHEN NOT contains(p_name, ' ') THEN 0.25 ELSE 0.0 END"


@registered(
    f"""WITH s AS (SELECT p_partkey, ((CASE WHEN p_name <> '' THEN 3.0::DOUBLE * 0.9::DOUBLE * (1 - {_TITLE_PENALTY}) ELSE 0 END) + (CASE WHEN p_brand <> '' THEN 1.5::DOUBLE * 0.9::DOUBLE ELSE 0 END) + (CASE WHEN p_retailprice IS NOT NULL THEN 2.0::DOUBLE * 0.9::DOUBLE ELSE 0 END)
      + (CASE WHEN p_type <> '' THEN 1.0::DOUBLE * 0.9::DOUBLE * (1 - CASE WHEN length(p_type) < 6 THEN 0.4 ELSE 0 END) ELSE 0 END)) / 7.5::DOUBLE AS x FROM part)
    SELECT round(x, 3) AS score, CASE WHEN x >= 0.8 THEN 'high' WHEN x >= 0.55 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM s GROUP BY 1, 2"""
)
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_type")
    title = F.when(F.length(name) < 4, 0.35).when(~name.contains(" "), 0.25).otherwise(0.0)
    score = Q.confidence({"title": name, "brand": F.col("p_brand"), "price": F.col("p_retailprice"), "category": kind}, {"title": title, "category": F.when(F.length(kind) < 6, 0.4).otherwise(0.0)})
    scored = table(spark, sf_dir, "part").select(score.alias("x"))
    return scored.groupBy(F.round("x", 3).alias("score"), money.confidence_level(F.col("x")).alias("level")).agg(F.count("*").alias("n"))


@registered(
    """WITH d AS (SELECT p_brand, CAST(100 * avg(CASE WHEN p_name <> '' THEN 1 ELSE 0 END) AS INT) AS d1, CAST(floor(100.0 * count(*) FILTER (p_size > 10) / count(*)) AS INT) AS d2, CAST(floor(100.0 * count(*) FILTER (p_retailprice > 950) / count(*)) AS INT) AS d3,
      CAST(floor(100.0 * count(DISTINCT p_type) / 6) AS INT) AS d4 FROM part GROUP BY 1)
    SELECT p_brand, CASE WHEN d1 = 0 THEN least(30, CAST(floor(round(d1 * 0.20 + d2 * 0.25 + d3 * 0.20 + d4 * 0.15, 6)) AS INT)) ELSE CAST(floor(round(d1 * 0.20 + d2 * 0.25 + d3 * 0.20 + d4 * 0.15, 6)) AS INT) END AS overall FROM d"""
)
def weighted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of each brand's catalogue by four dimensions."""
    share = lambda test: F.floor(100.0 * F.count_if(test) / F.count("*")).cast("int")
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        (100 * F.avg(F.when(~text.is_empty(F.col("p_name")), 1).otherwise(0))).cast("int").alias("D-AID1"), share(F.col("p_size") > 10).alias("D-AID2"), share(F.col("p_retailprice") > 950).alias("D-AID3"), F.floor(100.0 * F.count_distinct("p_type") / 6).cast("int").alias("D-AID4"),
    )
    names = ["D-AID1", "D-AID2", "D-AID3", "D-AID4"]
    return brands.select("p_brand", Q.audit_score({n: F.col(f"`{n}`") for n in names}).alias("overall"))


@registered("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\t\n\v\f\r ]+', ' ', 'g'))) || chr(31) || source) AS fingerprint FROM documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lower(F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", " "))), F.lit("\x1f"), F.col("source")), 256).alias("fingerprint"))


@registered("WITH f AS (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS place FROM documents) SELECT doc_id FROM f WHERE place = 1")
def upsert_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity upsert: the first record of each content stays. Contents meet by digest, so that no text is sorted."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def _link_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page as two candidate sets: labels that begin with a capital, and the others."""
    links = H.links(table(spark, sf_dir, "pages"))
    label, href = F.col("label"), F.col("href")
    detail = href.rlike(r"/[^/]{6,}$")
    noise = F.lower(label).isin("the", "and", "to", "of")
    score = L.record_score(label, href.startswith("/"), detail, noise, href.rlike(r"\d"), F.lower(href).rlike(r"^/(the|and|to|of)$"))
    return links.select(
        "page_id", F.when(label.rlike("^[A-Z]"), "named").otherwise("plain").alias("set_name"), score.alias("score"), detail.alias("detail_like"), (F.length(label) >= 5).alias("supported"),
        F.lower(href).rlike(r"^/(the|and|to|of)$").alias("utility"), F.when(F.length(label) > 6, "long").otherwise("short").alias("signature"),
    )


_LINKS = rf"""a AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS tag FROM pages),
  l AS (SELECT page_id, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(replace(replace(regexp_extract(tag, '(?is)>(.*)</a>', 1), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS label FROM a),
  r AS (SELECT page_id, CASE WHEN regexp_matches(label, '^[A-Z]') THEN 'named' ELSE 'plain' END AS set_name, regexp_matches(href, '/[^/]{{6,}}$') AS detail_like, length(label) >= 5 AS supported, regexp_matches(lower(href), '^/(the|and|to|of)$') AS utility,
    CASE WHEN length(label) > 6 THEN 'long' ELSE 'short' END AS signature,
    CASE WHEN label <> '' THEN 6 + CASE WHEN length(label) >= 12 THEN 1 ELSE 0 END ELSE -10 END + CASE WHEN lower(label) IN ('the', 'and', 'to', 'of') THEN -8 ELSE 0 END + CASE WHEN starts_with(href, '/') THEN 8 ELSE -12 END
    + CASE WHEN regexp_matches(href, '/[^/]{{6,}}$') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(href, '[0-9]') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(lower(href), '^/(the|and|to|of)$') THEN -16 ELSE 0 END AS score FROM l)"""
_SCORED = f"""{_LINKS}, g AS (SELECT page_id, set_name, signature, count(*) AS c, sum(score) AS total, count(*) FILTER (supported) AS supported, count(*) FILTER (detail_like) AS detail_like, count(*) FILTER (score >= 18) AS strong, count(*) FILTER (utility) AS utility FROM r GROUP BY 1, 2, 3),
  s AS (SELECT page_id, set_name, sum(c)::BIGINT AS n, max(c) / sum(c) AS homogeneity, sum(total)::BIGINT AS total, sum(supported)::BIGINT AS supported, sum(detail_like)::BIGINT AS detail_like, sum(strong)::BIGINT AS strong, sum(utility)::BIGINT AS utility,
    CAST(round(sum(total) / sum(c) * 100) AS BIGINT) AS average, max(c) / sum(c) >= 0.6 AS cohort FROM g GROUP BY 1, 2)"""


@registered(f"WITH {_LINKS} SELECT page_id, set_name, score, count(*) AS n FROM r GROUP BY 1, 2, 3")
def listing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_records(spark, sf_dir).groupBy("page_id", "set_name", "score").agg(F.count("*").alias("n"))


@registered(f"WITH {_SCORED} SELECT page_id, set_name, average FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY cohort DESC, average DESC, strong DESC, supported DESC, detail_like DESC, utility, total DESC, set_name) = 1")
def best_candidate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_set(L.set_scores(_link_records(spark, sf_dir), ["page_id", "set_name"]), "page_id", "set_name").select("page_id", "set_name", "average")


@registered(
    f"""WITH {_SCORED} SELECT page_id, set_name, CASE WHEN n > 0 AND n < 2 AND utility = n AND detail_like = 0 AND supported = 0 THEN 'below_min_records'
      WHEN homogeneity < 0.6 AND NOT (n >= 5 AND supported >= greatest(1, floor(n / 2))) THEN 'cohort_heterogeneous' WHEN n > 0 AND utility = n THEN 'all_sibling_category_urls'
      WHEN detail_like = 0 AND supported = 0 AND utility > 0 THEN 'no_support_signals' ELSE 'product_grid' END AS decision FROM s"""
)
def integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gate(L.set_scores(_link_records(spark, sf_dir), ["page_id", "set_name"])).select("page_id", "set_name", "decision")


@registered("SELECT o_orderpriority, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_records_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")
