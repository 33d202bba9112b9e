"""Record linkage: blocked pairs, features, and the ladder of identity signals."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import money, text

# Weights, floors and caps of the match score.
WEIGHTS = {"title_similarity": 0.45, "brand_match": 0.25, "gtin_match": 0.25, "style_code_match": 0.25, "shopping_product_group": 0.04, "price_band": 0.05, "source_authority": 0.18}
AUTHORITY = {"brand_dtc": 0.18, "retailer": 0.10, "marketplace": 0.06, "aggregator": 0.04, "unknown": 0.0}
FLOOR_GTIN, FLOOR_STYLE, FLOOR_STYLE_NO_BRAND, FLOOR_DTC, FLOOR_TITLE_PRICE, FLOOR_TITLE, FLOOR_MODEL, FLOOR_MEDIUM = 0.92, 0.92, 0.85, 0.90, 0.88, 0.85, 0.82, 0.65
TITLE_HIGH, TITLE_MEDIUM, TITLE_DTC, TITLE_GTIN = 0.90, 0.75, 0.50, 0.45
MISMATCH_PENALTY, MISMATCH_CAP, MODEL_CONTAINMENT = 0.15, 0.62, 0.6


def set_similarity(a: Column, b: Column) -> Column:
    """Token similarity without the sequence ratio: Jaccard, or a blend where the smaller set is nearly contained."""
    both, small, large = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    contained, coverage = both / small, both / large
    blend = F.when((contained >= 0.85) & (coverage >= 0.60) & (both >= 3), 0.8 * contained + 0.2 * coverage)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.coalesce(blend, text.jaccard(a, b)))


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """The larger of set similarity and sequence ratio times balance of sizes. The ratio has no built-in equal."""
    x, y = text.tokens(a), text.tokens(b)
    ratio = _sequence_ratio(F.array_join(F.array_sort(x), " "), F.array_join(F.array_sort(y), " "))
    balance = F.least(F.size(x), F.size(y)) / F.greatest(F.size(x), F.size(y), F.lit(1))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.greatest(set_similarity(x, y), ratio * balance))


def specs(title: Column) -> tuple[Column, Column]:
    """(numbers with units, counts of N-in-1) of a title."""
    low = F.lower(title)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?\s*-?\s*(?:gb|tb|oz|ml|inch|qt|cup|watt))\b"), 1))), F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(\d+)\s*-?\s*in\s*-?\s*1\b"), 1)))


def spec_mismatch(a: Column, b: Column) -> Column:
    """Both titles state a comparable specification and differ."""
    (units_a, many_a), (units_b, many_b) = specs(a), specs(b)
    differ = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) == 0)
    return differ(units_a, units_b) | differ(many_a, many_b)


def pairs(source: DataFrame, candidates: DataFrame, block: str) -> DataFrame:
    """Source rows with the candidates of the same block; columns get the prefixes s_ and c_. An equi join, so that a hot
    block is split by skewed joins."""
    a = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns))
    b = candidates.select(*(F.col(c).alias(f"c_{c}") for c in candidates.columns))
    return a.join(b, F.col(f"s_{block}") == F.col(f"c_{block}"))


def price_pairs(rows: DataFrame, block: list[str], price: str, share: float) -> DataFrame:
    """Pairs of rows of one block whose second price is within share of the first. Prices meet by logarithmic bins as wide as
    the band, a source's in its own and both neighbours, so that no block meets itself as a whole."""
    width = -math.log(1 - share)
    binned = rows.where(F.col(price) > 0).withColumn("_bin", F.floor(F.ln(price) / width))
    a = binned.select(*(F.col(c).alias(f"s_{c}") for c in rows.columns), F.explode(F.array(*(F.col("_bin") + k for k in (-1, 0, 1)))).alias("_s_bin"))
    b = binned.select(*(F.col(c).alias(f"c_{c}") for c in rows.columns), F.col("_bin").alias("_c_bin"))
    same = [F.col(f"s_{c}") == F.col(f"c_{c}") for c in block]
    return a.join(b, [*same, F.col("_s_bin") == F.col("_c_bin"), money.within_band(F.col(f"s_{price}"), F.col(f"c_{price}"), share)]).drop("_s_bin", "_c_bin")


def ladder(similarity: Column, brand: Column, price: Column, *, gtin: Column | None = None, style: Column | None = None, model: Column | None = None, source_type: Column | None = None, mismatch: Column | None = None, group: Column | None = None) -> tuple[Column, Column]:
    """(score, basis): weighted sum, raised to the floor of the strongest identity signal, capped on a mismatch."""
    no = F.lit(False)
    gtin, style, model, mismatch, group = (c if c is not None else no for c in (gtin, style, model, mismatch, group))
    kind = source_type if source_type is not None else F.lit("unknown")
    bonus = F.lit(0.0)
    for name, value in AUTHORITY.items():
        bonus = F.when(kind == name, value if name == "brand_dtc" else min(value, WEIGHTS["source_authority"])).otherwise(bonus)
    add = lambda flag, name: F.when(flag, WEIGHTS[name]).otherwise(0.0)
    base = similarity * WEIGHTS["title_similarity"] + add(brand, "brand_match") + add(gtin, "gtin_match") + add(style, "style_code_match") + add(group, "shopping_product_group") + add(price, "price_band") + bonus - F.when(mismatch, MISMATCH_PENALTY).otherwise(0.0)
    steps = [
        (gtin & brand & (similarity >= TITLE_GTIN), F.lit(FLOOR_GTIN), "gtin"),
        (style & ~mismatch, F.when(brand, FLOOR_STYLE).otherwise(FLOOR_STYLE_NO_BRAND), "style_code"),
        ((kind == "brand_dtc") & brand & (similarity >= TITLE_DTC), F.lit(FLOOR_DTC), "brand_dtc"),
        (~mismatch & brand & (similarity >= TITLE_HIGH), F.when(price, FLOOR_TITLE_PRICE).otherwise(FLOOR_TITLE), "brand+title"),
        (~mismatch & brand & model, F.lit(FLOOR_MODEL), "model+brand"),
        (~mismatch & brand & (similarity >= TITLE_MEDIUM), F.lit(FLOOR_MEDIUM), "brand+title"),
    ]
    floor, basis = F.lit(0.0), F.lit("title")
    for test, least, name in reversed(steps):
        floor, basis = F.when(test, least).otherwise(floor), F.when(test, name).otherwise(basis)
    score = F.greatest(base, floor)
    score = F.when(mismatch, F.least(score, F.lit(MISMATCH_CAP))).otherwise(score)
    return F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4), basis


def label(score: Column) -> Column:
    return money.score_label(score)
