"""Field candidates from any JSON: values under a field's name or alias, wherever they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import json_tree

#: Our own defaults. Keys under which values belong to variants, fields that a review's own values may not fill, and how
#: deep candidates are looked for.
VARIANT_KEYS = ["has_variant", "variants"]
NOT_FROM_REVIEWS = ["title", "description", "image_url", "additional_images"]
DEEPEST = 8


def candidates(df: DataFrame, json_col: str, keep: list[str], aliases: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """keep, field, place (from 1 by field in the order of the text), source and value, each value once a field.

    aliases: alias (a key in snake case) and field. Sources: `key`, a value under an alias, or those of a list of plain values
    under one; `pair`, the value of a {name, value} in additionalProperty whose name is an alias; `breadcrumb`, the
    names of a BreadcrumbList joined by ` > ` for field category. Values under variants fill nothing, those of reviews only what
    is not a product's."""
    rows = json_tree.values(df, json_col, keep, deepest).withColumn("_key", X.field_key(F.coalesce(F.col("key"), F.try_element_at(F.col("keys"), F.lit(-1)))))
    variant = F.exists("keys", lambda k: X.field_key(k).isin(*VARIANT_KEYS))
    around = lambda name: F.exists("types", lambda t: F.lower(t).contains(name))
    nearest = F.coalesce(F.lower(F.try_element_at(F.col("types"), F.lit(-1))), F.lit(""))
    plain = rows.where(F.col("kind").isin("string", "number", "boolean") & (F.trim("value") != "") & ~variant)
    names = F.broadcast(aliases.select(F.col("alias").alias("_key"), "field"))
    crumb = around("breadcrumblist") | nearest.contains("listitem")
    paired = F.coalesce(F.try_element_at(F.col("keys"), F.lit(-1)) == "additionalProperty", F.lit(False))
    named = plain.where(~crumb & ~paired & ~F.coalesce(F.col("key"), F.lit("")).startswith("@")).join(names, "_key").where(~(nearest.contains("review") & F.col("field").isin(*NOT_FROM_REVIEWS)))
    by_key = named.select(*keep, "field", F.col("place").alias("_at"), F.lit("key").alias("source"), "value")

    # name and value of one object meet by its place
    owner = [*keep, "parent"]
    pair = plain.where(paired & F.col("key").isin("name", "value")).groupBy(*owner).agg(*(F.min_by(F.col("value"), F.when(F.col("key") == k, F.col("place"))).alias(f"_{k}") for k in ("name", "value")), F.min("place").alias("_at"))
    by_pair = pair.withColumn("_key", X.field_key(F.col("_name"))).join(names, "_key").where("_value IS NOT NULL").select(*keep, "field", "_at", F.lit("pair").alias("source"), F.col("_value").alias("value"))

    steps = plain.where(around("breadcrumblist") & (F.col("key") == "name") & F.array_contains("keys", "itemListElement"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]), " > ")
    by_crumb = steps.groupBy(*keep).agg(path.alias("value"), F.min("place").alias("_at")).select(*keep, F.lit("category").alias("field"), "_at", F.lit("breadcrumb").alias("source"), "value")

    every = by_key.unionByName(by_pair).unionByName(by_crumb).withColumn("value", X.clean_text(F.col("value")))
    once = every.groupBy(*keep, "field", "value").agg(F.min(F.struct("_at", "source")).alias("x"))
    order = Window.partitionBy(*keep, "field").orderBy("x._at", "value")
    return once.withColumn("place", F.row_number().over(order)).select(*keep, "field", "place", F.col("x.source").alias("source"), "value")
