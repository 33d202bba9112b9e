"""Taxonomy: categories matched by tokens, term families, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def token_index(taxonomy: DataFrame) -> DataFrame:
    """category, path_length, n_tokens and token, one row a token."""
    t = taxonomy.select("category", F.size(F.split("category", " > ")).alias("path_length"), text.tokens(F.col("category")).alias("tokens"))
    return t.select("category", "path_length", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))


def token_scores(rows: DataFrame, key: str, title: str, taxonomy: DataFrame, least: float = 0.42) -> DataFrame:
    """(key, category, path_length, score): token overlap (shared tokens over the category's) from `least` on. Rows and
    categories meet by token, never all with all."""
    tokens = rows.select(key, F.explode(text.tokens(F.col(title))).alias("token"))
    shared = tokens.join(token_index(taxonomy), "token").groupBy(key, "category", "path_length", "n_tokens").agg(F.count("*").alias("shared"))
    return shared.select(key, "category", "path_length", (F.col("shared") / F.col("n_tokens")).alias("score")).where(F.col("score") >= least)


def best_categories(rows: DataFrame, key: str, title: str, taxonomy: DataFrame, least: float = 0.42, top: int = 1) -> DataFrame:
    """The categories of each row with the highest token_scores(), ties to the shorter path, then by name."""
    scored = token_scores(rows, key, title, taxonomy, least)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "path_length", "category")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(key, "category", "score", "place")


def family(c: Column, families: dict[str, list[str]]) -> Column:
    """The first family of which a term stands in the text as a word."""
    out = F.lit(None).cast("string")
    for name, terms in reversed(list(families.items())):
        out = F.when(c.isNotNull() & (F.lower(c).rlike("(^|[^a-z0-9])(" + "|".join(terms) + ")([^a-z0-9]|$)")), name).otherwise(out)
    return out


def keywords(parts: list[Column], title: Column, stopwords: list[str], most: int = 20) -> Column:
    """Words of all parts and pairs of words of the title, each once by its stem, of three letters and more."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(stopwords))
    single = F.array_distinct(words(F.concat_ws(" ", *parts)))
    candidates = F.filter(F.concat(single, text.bigrams(words(title))), lambda t: F.length(t) >= 3)
    pairs = F.transform(candidates, lambda t: F.struct(t.alias("word"), text.stem(t).alias("stem")))
    empty = F.slice(pairs, 1, 0)
    kept = F.aggregate(pairs, empty, lambda acc, p: F.when(F.exists(acc, lambda x: (x["stem"] == p["stem"]) | (x["word"] == p["word"])), acc).otherwise(F.concat(acc, F.array(p))))
    return F.slice(F.transform(kept, lambda x: x["word"]), 1, most)
