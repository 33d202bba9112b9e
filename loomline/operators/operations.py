"""Runs, monitors and jobs as rows: summaries, states, slots and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quality of sources by tier.
TIERS = {"authoritative": 1.0, "structured": 0.86, "dom": 0.72, "llm": 0.65, "text": 0.58}
# Failures in a row after which a monitor is in error.
FAILURE_LIMIT = 5


def run_states(polls: DataFrame, key: str, order: list[str], found: Column, met: Column, limit: int = FAILURE_LIMIT) -> DataFrame:
    """polls with `failures` (polls in a row without records, up to each) and status: triggered by a met condition, error from
    the limit on, else active."""
    by_key = Window.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(found, 1).otherwise(0)).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    out = polls.withColumn("_run", run).withColumn("_found", found)
    failures = F.sum(F.when(F.col("_found"), 0).otherwise(1)).over(Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("failures", failures)
    return out.withColumn("status", F.when(met, "triggered").when(F.col("failures") >= limit, "error").otherwise("active")).drop("_run", "_found")


def validator_changed(etag: Column, modified: Column, digest: Column, last_etag: Column, last_modified: Column, last_digest: Column) -> Column:
    """Whether a resource counts as changed: by its etag, else its date, else its digest; without any, or any before, yes."""
    known = last_etag.isNotNull() | last_modified.isNotNull() | last_digest.isNotNull()
    differs = F.when(etag.isNotNull(), ~etag.eqNullSafe(last_etag)).when(modified.isNotNull(), ~modified.eqNullSafe(last_modified)).when(digest.isNotNull(), ~digest.eqNullSafe(last_digest)).otherwise(True)
    return ~known | differs


def slots(requests: DataFrame, key: str, time: str, order: list[str], interval: float) -> DataFrame:
    """requests with `slot`: the seconds at which each may start, `interval` after the one before it of its key, no earlier
    than it came. The fold max(now, last) + interval is a running maximum of time less the place's intervals."""
    by_key = Window.partitionBy(key).orderBy(*order)
    place = F.row_number().over(by_key) - 1
    out = requests.withColumn("_place", place)
    ahead = F.max(F.col(time) - F.col("_place") * interval).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("slot", ahead + F.col("_place") * interval).drop("_place")


def tier_quality(sources: Column) -> tuple[Column, Column]:
    """(quality, tier) of the best source; unknown ones, and none, count as text."""
    quality = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))
    best = F.greatest(F.coalesce(F.array_max(F.transform(sources, lambda s: F.coalesce(F.try_element_at(quality, s), F.lit(TIERS["text"])))), F.lit(TIERS["text"])), F.lit(TIERS["text"]))
    tier = F.lit("text")
    for name, value in TIERS.items():
        tier = F.when(best == value, name).otherwise(tier)
    return best, tier


def aliased(record: Column, names: list[str]) -> Column:
    """The first of names whose value in record, a map, is not empty."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.coalesce(F.try_element_at(record, F.lit(name)), F.lit("")) != "", name).otherwise(out)
    return out


def coverage(required: Column, declared: Column, most: int) -> Column:
    """Points for the share of required fields that are declared; all where nothing is required."""
    return F.when(F.size(required) == 0, most).otherwise(F.floor(most * (F.size(F.filter(required, lambda r: F.array_contains(declared, r))) / F.size(required)))).cast("long")


#: When a listing's record goes: one line is enough. (points under this, flags that hold, flags that do not)
DROPS = [
    (0, "", ""),
    (10, "utility", ""),
    (10, "", "supported detail"),
    (None, "utility", "detail"),
    (None, "detail", "supported job merchandise"),
    (None, "", "supported job detail fallback"),
]


def dropped() -> Column:
    """Whether a record goes, by its columns score and those that DROPS names: service pages, and records without support."""
    lines = []
    for under, holding, lacking in DROPS:
        tests = [F.col(f) for f in holding.split()] + [~F.col(f) for f in lacking.split()] + ([] if under is None else [F.col("score") < under])
        lines.append(reduce(lambda x, y: x & y, tests))
    return reduce(lambda x, y: x | y, lines)
