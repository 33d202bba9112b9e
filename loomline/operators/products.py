"""Products: identity codes, search queries, variants' public form, and scored categories."""

from __future__ import annotations

import re
from functools import reduce

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import store

# Scores of categories met by a whole leaf, by a phrase of the path, and by all words of a leaf.
PHRASE_LEAF, PHRASE_PATH, LEAF_TOKENS = 1.3, 0.87, 0.84


def shared_codes(rows: DataFrame, key: str, codes: Column, least: int = 1) -> DataFrame:
    """Pairs (a, b) of rows that share `least` codes or more, with how many; null and empty codes are none.

    One code is enough to meet by where one is asked for: callers then pass codes that few rows share, as a code of everything
    says nothing of identity. From two on rows meet by pairs of their codes, so that those who meet are all in the result: pairs
    that one row alone has are dropped before any join, and m shared codes are met by m * (m - 1) / 2 times. A row's pairs grow
    with the square of its codes."""
    kept = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c.cast("string") != ""))))
    own = rows.select(F.col(key).alias("a"), kept.alias("_codes"))
    met = F.col("n")
    if least < 2:
        one = own.select("a", F.explode("_codes").alias("_x"))
        on = ["_x"]
    else:
        first = own.select("a", "_codes", F.posexplode("_codes").alias("_i", "_x"))
        pairs = first.select("a", "_x", F.explode(F.slice("_codes", F.col("_i") + 2, F.size("_codes"))).alias("_y"))
        on = ["_x", "_y"]
        one = store.kept(pairs.withColumn("_n", F.count("*").over(Window.partitionBy(*on))).where("_n > 1").drop("_n"), "shared")
        met = ((F.sqrt(8 * F.col("n") + 1) + 1) / 2).cast("long")
    both = one.join(one.withColumnRenamed("a", "b"), on).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return both.select("a", "b", met.alias("shared")).where(F.col("shared") >= least)


#: Queries for a product, the surest first: what has to be known, what has to be unknown, and the words. A code is the
#: article number, else the maker's number.
QUERY_TEMPLATES = [
    ("gtin", "", '"{gtin}"'),
    ("brand title site code", "", 'site:{site} "{code}"'),
    ("brand title site", "", "site:{site} {brand} {title}"),
    ("brand title code", "", '{brand} {title} "{code}"'),
    ("brand title", "", "{brand} {title}"),
    ("title code", "brand", '"{title}" "{code}"'),
    ("title", "brand", '"{title}" buy'),
]


def search_queries(brand: Column, title: Column, gtin: Column, mpn: Column, site: Column) -> Column:
    """The queries of QUERY_TEMPLATES that what is known of a product fills, each once."""
    known = {"brand": brand, "title": title, "gtin": gtin, "site": site, "code": F.when(text.is_empty(gtin), mpn).otherwise(gtin)}

    def made(needs: str, lacks: str, template: str) -> Column:
        pieces = [known[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"({\w+})", template) if p]
        tests = [~text.is_empty(known[n]) for n in needs.split()] + [text.is_empty(known[n]) for n in lacks.split()]
        return F.when(reduce(lambda x, y: x & y, tests), F.concat(*pieces))

    return F.array_distinct(F.array_compact(F.array(*(made(*t) for t in QUERY_TEMPLATES))))


def mislabelled(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether two axes are one under two names: the smaller one's values nearly all stand in the other."""
    fold = lambda c: F.array_distinct(F.filter(F.transform(c, text.equality_text), lambda v: v != ""))
    small = F.least(F.size(fold(a)), F.size(fold(b)))
    return (small > 0) & (F.size(F.array_intersect(fold(a), fold(b))) >= least * small)


def public_variants(variants: Column, fields: list[str], most: int) -> Column:
    """The first variants that have a value in one of fields, with these fields alone."""
    has = lambda v: reduce(lambda x, y: x | y, [~text.is_empty(v[f].cast("string")) for f in fields])
    return F.slice(F.transform(F.filter(variants, has), lambda v: F.struct(*(v[f].alias(f) for f in fields))), 1, most)


def valid_group(variants: Column) -> Column:
    """Whether variants are one product's: two at least, no two of one sku, and all with the same options."""
    skus = F.transform(F.filter(variants, lambda v: ~text.is_empty(v["sku"])), lambda v: v["sku"])
    axes = F.array_distinct(F.transform(variants, lambda v: F.array_join(F.array_sort(F.map_keys(v["options"])), "|")))
    return (F.size(variants) >= 2) & (F.size(F.array_distinct(skus)) == F.size(skus)) & (F.size(axes) == 1)


def phrase_scores(rows: DataFrame, key: str, title: str, taxonomy: DataFrame) -> DataFrame:
    """(key, category, path_length, score) of the categories that phrases of one to five words of a row's title name: a
    category's leaf, or a part of its path. Phrases meet categories by an equi join."""
    words = F.filter(F.split(F.lower(F.col(title)), "[^a-z0-9]+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.size("w"))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(5), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    phrases = rows.select(key, words.alias("w")).where(F.size("w") > 0).select(key, F.explode(F.array_distinct(spans)).alias("phrase"))
    parts = F.transform(F.split(F.lower("category"), " > "), lambda p: F.trim(p))
    index = taxonomy.select("category", F.size(parts).alias("path_length"), F.posexplode(parts).alias("at", "part"))
    index = index.select("category", "path_length", "part", F.when(F.col("at") == F.col("path_length") - 1, PHRASE_LEAF).otherwise(PHRASE_PATH).alias("score"))
    met = phrases.join(index, F.col("phrase") == F.col("part"))
    return met.groupBy(key, "category", "path_length").agg(F.max("score").alias("score"))


def phrase_categories(rows: DataFrame, key: str, title: str, taxonomy: DataFrame) -> DataFrame:
    """Each row's best category by phrase_scores(); ties go to the shorter path, then by name."""
    return phrase_scores(rows, key, title, taxonomy).groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "path_length", "category")).alias("b")).select(key, "b.category", (-F.col("b.s")).alias("score"))
