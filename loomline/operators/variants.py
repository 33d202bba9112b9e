"""Variants: arrays of structs (id, sku, options as a map, price, stock)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def identity(v: Column) -> Column:
    """id, else sku, else the sorted options."""
    options = F.array_join(F.array_sort(F.transform(F.map_entries(v["options"]), lambda e: F.concat_ws("=", F.lower(e["key"]), F.lower(e["value"])))), "|")
    return F.coalesce(F.when(~text.is_empty(v["id"]), F.concat(F.lit("id:"), v["id"])), F.when(~text.is_empty(v["sku"]), F.concat(F.lit("sku:"), v["sku"])), F.when(options != "", F.concat(F.lit("options:"), options)))


def richness(v: Column) -> Column:
    """Populated fields, options, and whether price or stock is known."""
    has = lambda c: F.when(~text.is_empty(c.cast("string")), 1).otherwise(0)
    return F.struct((has(v["id"]) + has(v["sku"]) + has(v["price"]) + has(v["stock"])).alias("fields"), F.coalesce(F.size(v["options"]), F.lit(0)).alias("options"), F.greatest(has(v["price"]), has(v["stock"])).alias("offer"))


def merged(df: DataFrame, key: str, variants: str = "variants") -> DataFrame:
    """One row a variant of each record: of those with one identity the richest leads, ties to the first, and blanks are
    filled from the others in order of richness. Rows without identity stay as they are, after the others."""
    rows = df.select(key, F.posexplode(variants).alias("place", "v")).withColumn("identity", identity(F.col("v"))).withColumn("rich", richness(F.col("v")))
    known = rows.where("identity IS NOT NULL")
    w = Window.partitionBy(key, "identity").orderBy(F.desc("rich"), "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda f: F.first(F.when(~text.is_empty(F.col(f"v.{f}").cast("string")), F.col(f"v.{f}")), ignorenulls=True).over(w)
    filled = known.select(key, F.min("place").over(w).alias("place"), "identity", F.row_number().over(Window.partitionBy(key, "identity").orderBy(F.desc("rich"), "place")).alias("n"), *(first(f).alias(f) for f in ("id", "sku", "price", "stock")), F.first("v.options").over(w).alias("options"))
    rest = rows.where("identity IS NULL").select(key, (F.col("place") + 1_000_000).alias("place"), "identity", *(F.col(f"v.{f}") for f in ("id", "sku", "price", "stock", "options")))
    return filled.where("n = 1").drop("n").unionByName(rest)


def axes(df: DataFrame, key: str, variants: str = "variants") -> DataFrame:
    """Distinct values of each option of a record, in first order."""
    options = df.select(key, F.posexplode(variants).alias("place", "v")).select(key, "place", F.explode("v.options").alias("axis", "value"))
    first = options.groupBy(key, "axis", "value").agg(F.min("place").alias("place"))
    return first.groupBy(key, "axis").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s")).select(key, "axis", F.transform("s", lambda x: x["value"]).alias("values"))
