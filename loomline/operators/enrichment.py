"""Deterministic enrichment of products: category, attributes, size, tags and keywords in one record, by tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import text as X
from . import products, taxonomy

#: Our own defaults: systems of sizes by the words that tell them, and letters that are sizes.
SIZE_SYSTEMS = {"eu": r"\b(?:eu|eur)\b", "uk": r"\buk\b", "us": r"\bus\b", "jp": r"\b(?:jp|jpn)\b"}
LETTERS = "xxxl|xxl|xxs|xl|xs|s|m|l"


def size_of(c: Column) -> Column:
    """The size that a text states, in capitals: behind `size` or a system's name, before a system's name, or the text itself.
    Null where it states none."""
    low = F.lower(X.collapse(c))
    number = rf"\d{{1,3}}(?:[.,]\d)?|{LETTERS}"
    systems = "eu|eur|uk|us|jp|jpn"
    found = [F.regexp_extract(low, p, 1) for p in (rf"\b(?:size|{systems})\b\W*(?:(?:{systems})\b\W*)?({number})\b", rf"\b({number})\s*(?:{systems})\b", rf"^({number})$")]
    return F.upper(F.coalesce(*(F.nullif(f, F.lit("")) for f in found)))


def size_system(c: Column) -> Column:
    """The system that the text names; alpha for letters without one; null where no size is stated."""
    named = F.lit(None).cast("string")
    for system, pattern in reversed(list(SIZE_SYSTEMS.items())):
        named = F.when(F.lower(c).rlike(pattern), system).otherwise(named)
    size = size_of(c)
    return F.when(size.isNotNull(), F.coalesce(named, F.when(size.rlike("^[A-Z]+$"), "alpha").otherwise("unknown")))


def ruled_out(rows: DataFrame, key: str, title: str, conflicts: DataFrame) -> DataFrame:
    """(key, branch): the taxonomy's branches that a word of the title rules out. conflicts: word and branch."""
    words = rows.select(key, F.explode(F.array_distinct(F.split(F.lower(F.col(title)), "[^a-z0-9]+"))).alias("word"))
    return words.join(conflicts, "word").select(key, "branch").distinct()


def categories(rows: DataFrame, key: str, title: str, tree: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(key, category, score): each row's best category by phrases and by shared tokens that no word of its title rules out.
    Ties go to the shorter path, then by name."""
    by_phrase = products.phrase_scores(rows, key, title, tree).select(key, "category", "score")
    by_token = taxonomy.token_scores(rows, key, title, tree).select(key, "category", "score")
    every = by_phrase.unionByName(by_token).groupBy(key, "category").agg(F.max("score").alias("score")).withColumn("branch", F.split("category", " > ")[0])
    left = every.join(ruled_out(rows, key, title, conflicts), [key, "branch"], "left_anti")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.size(F.split("category", " > ")).alias("n"), "category")).alias("b")
    return left.groupBy(key).agg(best).select(key, "b.category", (-F.col("b.s")).alias("score"))


def attributes(c: Column, vocabulary: dict[str, dict[str, list[str]]]) -> Column:
    """A map from each attribute (attribute -> value -> terms) that the text states to its value."""
    pairs = F.array(*(F.struct(F.lit(name).alias("k"), taxonomy.family(c, values).alias("v")) for name, values in vocabulary.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def tags(rules: list[tuple[str, Column]], own: list[Column]) -> Column:
    """The tags of the rules that hold, and those that are made, in order of name."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(test, tag) for tag, test in rules), *own))))


def projection(rows: DataFrame, key: str, tree: DataFrame, conflicts: DataFrame, vocabulary: dict[str, dict[str, list[str]]], rules: list[tuple[str, Column]], stopwords: list[str]) -> DataFrame:
    """One record a product (key, title, brand, description): category and score, the attributes that its texts state and
    those of the vocabulary that they do not, size and system, materials, tags and search words. Without a category it
    stands all the same. Rows and categories meet by words; all else is computed row by row."""
    said = F.concat_ws(" ", "title", "description")
    found = rows.select("*", attributes(said, vocabulary).alias("attributes"))
    out = found.join(categories(rows, key, "title", tree, conflicts), key, "left")
    wanted = F.array(*map(F.lit, sorted(vocabulary)))
    brand = F.concat(F.lit("brand:"), F.lower(F.trim("brand")))
    return out.select(
        key, "category", "score", "attributes", F.array_except(wanted, F.map_keys("attributes")).alias("missing"), size_of(F.col("description")).alias("size"), size_system(F.col("description")).alias("size_system"),
        V.materials(F.coalesce("description", F.lit(""))).alias("materials"), tags(rules, [F.when(F.trim("brand") != "", brand), *(F.concat(F.lit(f"{n}:"), F.try_element_at("attributes", F.lit(n))) for n in sorted(vocabulary))]).alias("tags"),
        taxonomy.keywords([F.coalesce("title", F.lit("")), F.coalesce("brand", F.lit(""))], F.coalesce("title", F.lit("")), stopwords).alias("keywords"),
    )
