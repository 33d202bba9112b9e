"""Listings: scores of candidate records, the best candidate set, and the integrity gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the gate and of a strong record.
LEAST_RECORDS, LEAST_RATIO, STRONG = 2, 0.6, 18


def record_score(title: Column, good_url: Column, detail_like: Column, noise: Column, priced: Column, utility: Column) -> Column:
    """Points for title, URL and support, against noise and utility links."""
    points = F.when(title != "", F.lit(6) + F.when(F.length(title) >= 12, 1).otherwise(0)).otherwise(-10)
    add = lambda flag, yes, no=0: F.when(flag, yes).otherwise(no)
    return points + add(noise, -8) + add(good_url, 8, -12) + add(detail_like, 5) + add(priced, 6) + add(utility, -16)


def set_scores(records: DataFrame, keys: list[str]) -> DataFrame:
    """Comparands of each candidate set (columns score, supported, detail_like, utility, signature of records)."""
    w = [F.count_if("supported").alias("supported"), F.count_if("detail_like").alias("detail_like"), F.count_if(F.col("score") >= STRONG).alias("strong"), F.count_if("utility").alias("utility")]
    sized = records.groupBy(*keys, "signature").agg(F.count("*").alias("c"), F.sum("score").alias("total"), *w)
    sums = [F.sum(c).alias(c) for c in ("supported", "detail_like", "strong", "utility")]
    out = sized.groupBy(*keys).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("homogeneity"), F.sum("total").alias("total"), *sums)
    return out.withColumn("average", F.round(F.col("total") / F.col("n") * 100).cast("long")).withColumn("cohort", F.col("homogeneity") >= LEAST_RATIO)


def best_set(scored: DataFrame, page: str, set_name: str) -> DataFrame:
    """The set of each page that is first by the comparands; ties go by name."""
    order = [F.desc("cohort"), F.desc("average"), F.desc("strong"), F.desc("supported"), F.desc("detail_like"), "utility", F.desc("total"), set_name]
    return scored.withColumn("_place", F.row_number().over(Window.partitionBy(page).orderBy(*order))).where("_place = 1").drop("_place")


def gate(scored: DataFrame) -> DataFrame:
    """Adds decision, by five rules in order."""
    n, siblings, details, supported = F.col("n"), F.col("utility"), F.col("detail_like"), F.col("supported")
    decision = (
        F.when((n > 0) & (n < LEAST_RECORDS) & (siblings == n) & (details == 0) & (supported == 0), "below_min_records")
        .when((F.col("homogeneity") < LEAST_RATIO) & ~((n >= 5) & (supported >= F.greatest(F.lit(1), F.floor(n / 2)))), "cohort_heterogeneous")
        .when((n > 0) & (siblings == n), "all_sibling_category_urls")
        .when((details == 0) & (supported == 0) & (siblings > 0), "no_support_signals")
        .otherwise("product_grid")
    )
    return scored.withColumn("decision", decision)
