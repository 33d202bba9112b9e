"""Queries that link, classify and enrich products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import linkage as K
from ..operators import taxonomy as T
from .registry import registered, table

_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) > 1))"
_BOTH = "len(list_intersect(a.t, b.t))"
_UNION = "len(list_distinct(list_concat(a.t, b.t)))"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles of a brand with their number of parts and mean price: copies are folded before pairs are made."""
    parts = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("price"))
    return parts.select("p_brand", "p_name", "n", "price", text.tokens(F.col("p_name")).alias("t"))


_FOLDED = f"t AS (SELECT p_brand, p_name, count(*) AS n, round(avg(p_retailprice), 2) AS price, {_TOKENS.format('p_name')} AS t FROM part GROUP BY 1, 2)"


@registered(f"WITH {_FOLDED} SELECT a.p_brand AS brand, a.p_name AS left_title, b.p_name AS right_title, {_BOTH} / {_UNION} AS jaccard FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name < b.p_name AND {_BOTH} > 0 WHERE {_BOTH} / {_UNION} >= 0.3")
def title_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles of one brand that share a token, with their similarity. They meet by brand and token."""
    titles = _titles(spark, sf_dir)
    tokens = titles.select("p_brand", "p_name", "t", F.explode("t").alias("token"))
    other = tokens.select(F.col("p_brand").alias("b_brand"), F.col("p_name").alias("b_name"), F.col("t").alias("b_t"), F.col("token").alias("b_token"))
    met = tokens.join(other, (F.col("p_brand") == F.col("b_brand")) & (F.col("token") == F.col("b_token")) & (F.col("p_name") < F.col("b_name")))
    pairs = met.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("left_title"), F.col("b_name").alias("right_title"), text.jaccard(F.col("t"), F.col("b_t")).alias("jaccard"))
    return pairs.where("jaccard >= 0.3").distinct()


@registered(
    f"""WITH {_FOLDED} SELECT a.p_brand AS brand, count(*) AS pairs, count(*) FILTER (a.price > 0 AND b.price > 0 AND abs(a.price - b.price) <= 0.001 * a.price) AS in_band FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name GROUP BY 1"""
)
def price_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles of a brand, and those within a narrow band of the source's price (the band is not symmetric)."""
    titles = _titles(spark, sf_dir).select("p_brand", "p_name", "price")
    counts = titles.groupBy("p_brand").agg((F.count("*") * (F.count("*") - 1)).alias("pairs")).where("pairs > 0")
    met = K.price_pairs(titles.where("price > 0"), ["p_brand"], "price", 0.001).where("s_p_name <> c_p_name")
    near = met.groupBy(F.col("s_p_brand").alias("_brand")).agg(F.count("*").alias("n"))
    return counts.join(near, F.col("p_brand") == F.col("_brand"), "left").select(F.col("p_brand").alias("brand"), "pairs", F.coalesce("n", F.lit(0)).alias("in_band"))


_SIM = f"CASE WHEN {_BOTH} / least(len(a.t), len(b.t)) >= 0.85 AND {_BOTH} / greatest(len(a.t), len(b.t)) >= 0.6 AND {_BOTH} >= 3 THEN 0.8 * {_BOTH} / least(len(a.t), len(b.t)) + 0.2 * {_BOTH} / greatest(len(a.t), len(b.t)) ELSE {_BOTH} / {_UNION} END"


@registered(
    f"""WITH {_FOLDED}, p AS (SELECT a.p_brand AS brand, a.p_name AS source, b.p_name AS candidate, ({_SIM})::DOUBLE AS sim, a.price > 0 AND b.price > 0 AND abs(a.price - b.price) <= 0.25 * a.price AS band FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name),
    s AS (SELECT *, 0.45 * sim + 0.25 + CASE WHEN band THEN 0.05 ELSE 0 END + 0.10 AS base, CASE WHEN sim >= 0.9 THEN CASE WHEN band THEN 0.88 ELSE 0.85 END WHEN sim >= 0.75 THEN 0.65 ELSE 0 END AS floor FROM p),
    f AS (SELECT *, least(greatest(base, floor), 1.0) AS x FROM s)
    SELECT brand, CASE WHEN sim >= 0.75 THEN 'brand+title' ELSE 'title' END AS basis, CASE WHEN x >= 0.85 THEN 'high' WHEN x >= 0.6 THEN 'medium' WHEN x >= 0.4 THEN 'low' ELSE 'uncertain' END AS label, count(*) AS n, round(max(x), 3) AS best FROM f GROUP BY 1, 2, 3"""
)
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of pairs within a brand, by the ladder without the sequence ratio."""
    titles = _titles(spark, sf_dir).select("p_brand", "p_name", "price", "t")
    met = K.pairs(titles, titles, "p_brand").where(F.col("s_p_name") != F.col("c_p_name"))
    met = met.withColumn("sim", K.set_similarity(F.col("s_t"), F.col("c_t")))
    score, basis = K.ladder(F.col("sim"), F.lit(True), money.within_band(F.col("s_price"), F.col("c_price")), source_type=F.lit("retailer"))
    scored = met.select(F.col("s_p_brand").alias("brand"), basis.alias("basis"), score.alias("x"))
    return scored.groupBy("brand", "basis", K.label(F.col("x")).alias("label")).agg(F.count("*").alias("n"), F.round(F.max("x"), 3).alias("best"))


@registered()
def match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder with the sequence ratio, for titles that share a token: the best candidate of each title."""
    titles = _titles(spark, sf_dir)
    tokens = titles.select("p_brand", "p_name", "price", F.explode("t").alias("token"))
    met = K.pairs(tokens, tokens, "token").where(F.col("s_p_brand") == F.col("c_p_brand")).where(F.col("s_p_name") != F.col("c_p_name"))
    met = met.dropDuplicates(["s_p_brand", "s_p_name", "c_p_name"])
    met = met.withColumn("sim", K.title_similarity(F.col("s_p_name"), F.col("c_p_name")))
    score, basis = K.ladder(F.col("sim"), F.lit(True), money.within_band(F.col("s_price"), F.col("c_price")), mismatch=K.spec_mismatch(F.col("s_p_name"), F.col("c_p_name")))
    best = F.max(F.struct(score.alias("score"), F.col("c_p_name").alias("candidate"), basis.alias("basis"))).alias("b")
    return met.groupBy(F.col("s_p_brand").alias("brand"), F.col("s_p_name").alias("source")).agg(best).select("brand", "source", "b.*")


# A small taxonomy of our own over the fixture's words.
TAXONOMY = ["Hardware > Fasteners > Bolt", "Hardware > Widgets > Red Widget", "Hardware > Widgets > Widget", "Jewellery > Ring", "Jewellery > Ring > Small Ring", "Tools > Blue Gear", "Tools > Gear", "Parts > Large Bolt"]
_TAXONOMY = ", ".join(f"('{c}')" for c in TAXONOMY)


@registered(
    f"""WITH c AS (SELECT col0 AS category, len(string_split(col0, ' > ')) AS path_length, {_TOKENS.format('col0')} AS t FROM (VALUES {_TAXONOMY}) v), i AS (SELECT category, path_length, len(t) AS n, unnest(t) AS token FROM c),
    p AS (SELECT p_partkey, unnest({_TOKENS.format('p_name')}) AS token FROM part), s AS (SELECT p_partkey, category, path_length, count(*) / n AS score FROM p JOIN i USING (token) GROUP BY p_partkey, category, path_length, n)
    SELECT p_partkey, category, score FROM s WHERE score >= 0.42 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, path_length, category) = 1"""
)
def taxonomy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxonomy = spark.createDataFrame([(c,) for c in TAXONOMY], "category string")
    return T.best_categories(table(spark, sf_dir, "part"), "p_partkey", "p_name", taxonomy).select("p_partkey", "category", "score")


FAMILIES = {"red": ["red", "crimson"], "blue": ["blue", "navy"], "small": ["small", "mini"], "large": ["large", "big"]}


@registered(
    """SELECT CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(red|crimson)([^a-z0-9]|$)') THEN 'red' WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(blue|navy)([^a-z0-9]|$)') THEN 'blue'
      WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(small|mini)([^a-z0-9]|$)') THEN 'small' WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(large|big)([^a-z0-9]|$)') THEN 'large' END AS family, count(*) AS n FROM part GROUP BY 1"""
)
def term_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(T.family(F.col("p_name"), FAMILIES).alias("family")).agg(F.count("*").alias("n"))


@registered()
def seo_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", T.keywords([F.col("p_name"), F.col("p_brand"), F.col("p_type")], F.col("p_name"), ["the", "and", "of", "for"]).alias("keywords"))
