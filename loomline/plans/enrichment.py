"""Queries that enrich, compare and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import extraction as E
from ..operators import taxonomy as T
from .linkage import _TAXONOMY, _TOKENS, TAXONOMY
from .registry import registered, table

_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) > 1))"


@registered(
    """WITH r AS (SELECT p_brand, p_type, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS variants, avg(p_retailprice) AS mean FROM part GROUP BY 1, 2)
    SELECT p_brand, p_type, low, high, variants, round(mean, 2) AS parent, mean < low OR mean > high AS outside FROM r"""
)
def variant_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of variants' prices and whether the parent's lies outside."""
    mean = F.avg("p_retailprice")
    groups = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.count("*").alias("variants"), mean.alias("mean"))
    return groups.select("p_brand", "p_type", "low", "high", "variants", F.round("mean", 2).alias("parent"), ((F.col("mean") < F.col("low")) | (F.col("mean") > F.col("high"))).alias("outside"))


@registered(f"WITH t AS (SELECT p_type, unnest({_TOKENS.format('p_name')}) AS token FROM part) SELECT p_type, token, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 2")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "part").select("p_type", F.explode(text.tokens(F.col("p_name"))).alias("token"))
    return tokens.groupBy("p_type", "token").agg(F.count("*").alias("n")).where("n >= 2")


LEAVES = ["red widget", "small ring", "blue bolt", "large gear"]


@registered("SELECT p_partkey, lower(trim(p_name)) AS leaf, 0.92::DOUBLE AS score FROM part WHERE lower(trim(p_name)) IN ('red widget', 'small ring', 'blue bolt', 'large gear')")
def exact_leaf_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = spark.createDataFrame([(x,) for x in LEAVES], "leaf string")
    return table(spark, sf_dir, "part").select("p_partkey", text.equality_text(F.col("p_name")).alias("leaf")).join(leaves, "leaf").select("p_partkey", "leaf", F.lit(0.92).alias("score"))


@registered(
    """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents WHERE lang = 'en'),
    b AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM d)
    SELECT phrase, count(*) AS docs FROM b GROUP BY 1 HAVING count(*) >= 40"""
)
def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words that stand in forty documents or more."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != "")
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", words.alias("w"))
    return docs.select(F.explode(text.bigrams(F.col("w"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("docs")).where("docs >= 40")


@registered(
    """WITH a AS (SELECT page_id, lower(trim(regexp_replace(url, '#.*$', ''))) AS k, 0 AS list FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, lower(trim(regexp_replace(url, '#.*$', ''))), 1 FROM pages),
    f AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(k, '/+$', '') ORDER BY list, page_id) AS n FROM a)
    SELECT page_id, list FROM f WHERE n = 1"""
)
def merged_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists, the first before the second; one row a URL without fragment and trailing slash."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("ord"))
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace("url", "#.*$", ""))), "/+$", "")
    first, second = pages.where("page_id % 2 = 0").withColumn("list", F.lit(0)), pages.withColumn("list", F.lit(1))
    both = first.unionByName(second).withColumn("k", key)
    return both.groupBy("k").agg(F.min(F.struct("list", "page_id")).alias("b")).select("b.page_id", "b.list")


@registered("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, count(*) AS orders FROM orders GROUP BY 1")
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(first, F.count("*").alias("orders")).select("o_custkey", F.col("f.o_orderkey").alias("first_order"), "orders")


@registered("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def records_in_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_semi").select("c_custkey")


@registered(
    """WITH a AS (SELECT l_partkey, min(l_returnflag) AS lo, max(l_returnflag) AS hi, count(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY 1)
    SELECT (lo <> hi)::INT + (states > 1)::INT AS contradictions, count(*) AS n FROM a GROUP BY 1"""
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields of a part its sources disagree on."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.min("l_returnflag") != F.max("l_returnflag")).cast("int").alias("a"), (F.count_distinct("l_linestatus") > 1).cast("int").alias("b"))
    return facts.groupBy((F.col("a") + F.col("b")).alias("contradictions")).agg(F.count("*").alias("n"))


@registered(
    """WITH s AS (SELECT s_suppkey, count(*) AS records, count(*) FILTER (l_discount > 0) AS discounted, count(*) FILTER (l_tax > 0) AS taxed FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
    SELECT s_suppkey, records, CAST(floor(100 * (discounted + taxed) / (records * 2)) AS INT) AS completeness, CASE WHEN discounted / records < 0.5 THEN 'critical' WHEN taxed / records < 0.5 THEN 'high' ELSE 'medium' END AS priority FROM s"""
)
def catalog_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    by = joined.groupBy("s_suppkey").agg(F.count("*").alias("records"), F.count_if(F.col("l_discount") > 0).alias("d"), F.count_if(F.col("l_tax") > 0).alias("t"))
    priority = F.when(F.col("d") / F.col("records") < 0.5, "critical").when(F.col("t") / F.col("records") < 0.5, "high").otherwise("medium")
    return by.select("s_suppkey", "records", F.floor(100 * (F.col("d") + F.col("t")) / (F.col("records") * 2)).cast("int").alias("completeness"), priority.alias("priority"))


@registered(
    """SELECT CASE WHEN p_retailprice > 0 AND l_extendedprice / l_quantity / p_retailprice >= 50 THEN 'magnitude' WHEN l_discount > 0.09 THEN 'discount' WHEN l_extendedprice <= 0 THEN 'zero' ELSE 'sound' END AS state, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def price_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices off by orders of magnitude, odd discounts, and zero prices."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    state = F.when((F.col("p_retailprice") > 0) & (F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice") >= 50), "magnitude").when(F.col("l_discount") > 0.09, "discount").when(F.col("l_extendedprice") <= 0, "zero").otherwise("sound")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@registered("SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total_cents, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum and count, of which means follow; in whole cents, so that the order of adding does not show."""
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("total_cents"), F.count("*").over(w).alias("n"))


@registered(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'sold out' WHEN p_size % 5 = 1 THEN 'available' WHEN p_size % 5 = 2 THEN 'only few' ELSE 'soon' END AS shown,
      CASE WHEN p_size % 5 = 0 THEN 'out_of_stock' WHEN p_size % 5 = 1 THEN 'in_stock' WHEN p_size % 5 = 2 THEN 'limited_stock' END AS availability FROM part"""
)
def availability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.col("p_size") % 5
    shown = F.when(rest == 0, "sold out").when(rest == 1, "available").when(rest == 2, "only few").otherwise("soon")
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown")).select("p_partkey", "shown", money.availability(F.col("shown")).alias("availability"))


@registered("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::BIGINT AS words, ceil(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) / 200)::BIGINT AS minutes FROM documents")
def reading_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.word_count(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), text.reading_minutes(words).cast("long").alias("minutes"))


@registered(
    f"""WITH c AS (SELECT col0 AS category, len(string_split(col0, ' > ')) AS path_length, {_TOKENS.format('col0')} AS t FROM (VALUES {_TAXONOMY}) v), i AS (SELECT category, path_length, len(t) AS n, unnest(t) AS token FROM c),
    p AS (SELECT p_partkey, unnest({_TOKENS.format('p_name')}) AS token FROM part), s AS (SELECT p_partkey, category, path_length, count(*) / n AS score FROM p JOIN i USING (token) GROUP BY p_partkey, category, path_length, n)
    SELECT p_partkey, category, score, (row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, path_length, category))::INT AS place FROM s WHERE score >= 0.2 QUALIFY place <= 3"""
)
def best_taxonomy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best categories of each part."""
    taxonomy = spark.createDataFrame([(c,) for c in TAXONOMY], "category string")
    return T.best_categories(table(spark, sf_dir, "part"), "p_partkey", "p_name", taxonomy, least=0.2, top=3)


@registered("SELECT p_brand, string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) AS types FROM part GROUP BY 1")
def multi_value_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct values of a multi-valued field, in order."""
    kinds = table(spark, sf_dir, "part").select("p_brand", F.lit("types").alias("field"), F.lit("dom").alias("tier"), F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_type")).alias("ord"), F.col("p_type").alias("value")).distinct()
    return E.winners(kinds, "p_brand", ["types"]).select("p_brand", F.col("value").alias("types"))
