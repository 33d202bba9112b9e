"""Which page, value or record counts: domains, stated surfaces, paths of rules, results of several adapters, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U


def of_domain(url: Column, domain: Column) -> Column:
    """Whether a URL is a domain's or its www host's: the bare origin, or followed by a path or a port."""
    rest = F.lower(url)
    for scheme in ("http://", "https://"):
        rest = F.when(rest.startswith(scheme), F.substr(rest, F.lit(len(scheme) + 1))).otherwise(rest)
    schemed = F.lower(url).startswith("http://") | F.lower(url).startswith("https://")
    after = lambda host: F.when(rest.startswith(host), F.substr(rest, F.length(host) + 1))
    fits = lambda tail: F.coalesce((tail == "") | tail.startswith("/") | tail.startswith(":"), F.lit(False))
    return schemed & (fits(after(domain)) | fits(after(F.concat(F.lit("www."), domain))))


def chosen_surface(requested: Column, url: Column) -> tuple[Column, Column]:
    """(surface, confidence): a stated surface is taken as it is, in lower case; blank ones and `auto` are found by the URL."""
    stated = F.lower(F.trim(F.coalesce(requested, F.lit(""))))
    auto = (stated == "") | (stated == "auto")
    name, sure = U.surface(url)
    return F.when(auto, name).otherwise(stated), F.when(auto, sure).otherwise(1.0)


def variant_value(variants: Column, field: str, match) -> Column:
    """`variants[*].field` of a rule that names a variant: the field of the first that matches, null without one."""
    return F.get(F.filter(variants, match), F.lit(0))[field]


def variant_values(variants: Column, identity, field: str) -> Column:
    """`variants[*].field` of a rule that names none: a map from each variant's identity; of equal ones the last stays."""
    last = lambda v, i: ~F.exists(F.slice(variants, i + 2, F.size(variants)), lambda w: identity(w) == identity(v))
    return F.map_from_entries(F.transform(F.filter(variants, last), lambda v: F.struct(identity(v), v[field])))


def merged_results(records: DataFrame, adapter: str, key: str, fields: list[str]) -> DataFrame:
    """One record a key, each field from the adapter with the most filled fields that has it; ties go to the lesser name, then
    to the lesser value. Null and blank fields do not count. Rows without a key are dropped."""
    filled = {f: F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "") for f in fields}
    total = F.lit(0)
    for f in fields:
        total = total + filled[f].cast("long")
    scores = records.groupBy(F.col(adapter).alias("_adapter")).agg(F.sum(total).alias("_score"))
    met = records.where(F.col(key).isNotNull()).join(scores, F.col(adapter) == F.col("_adapter"))
    # the least struct by partial aggregation, so that a hot key is folded before its shuffle
    best = lambda f: F.min(F.when(filled[f], F.struct(-F.col("_score"), F.col(adapter), F.col(f).alias("v"))))["v"].alias(f)
    return met.groupBy(key).agg(*(best(f) for f in fields))


def latest_page(events: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first page of each key's events, `most` of them at most, by order."""
    return events.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def bundles(records: DataFrame, tables: DataFrame, key: str, fields: list[str], name: str = "table_rows") -> DataFrame:
    """records with their counted table rows, their fields without blanks as a map, and null in place of an empty map."""
    counts = tables.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name))
    entries = F.map_from_arrays(F.array(*(F.lit(f) for f in fields)), F.array(*(F.col(f).cast("string") for f in fields)))
    whole = F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))
    out = records.join(counts, F.col(key) == F.col("_key"), "left").drop("_key")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)), "structured_record": F.when(F.size(whole) > 0, whole)})
