"""Monitors: snapshots, their differences, alert conditions, due jobs and retention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text

# Conditions name these fields and operators.
CONDITION_FIELDS = ("price", "availability")
OPERATORS = ("<=", ">=", "==", "!=", "<", ">")
_CLAUSE = re.compile(r"^\s*([A-Za-z_]\w*)\s*(<=|>=|==|!=|<|>)\s*(\"[^\"]*\"|'[^']*'|-?\d+(?:\.\d+)?|[A-Za-z_]\w*)\s*$", re.ASCII)


def condition(rule: str | None, fields: dict[str, Column]) -> Column:
    """`field op value [AND ...]` as a predicate. Empty rules hold; unknown fields and other syntax are errors. Prices
    compare as numbers, other fields as normalised text by == and != only. A missing value fulfils nothing but !=."""
    if not rule or not rule.strip():
        return F.lit(True)
    out = F.lit(True)
    for clause in re.split(r"\s+AND\s+", rule.strip(), flags=re.IGNORECASE):
        match = _CLAUSE.match(clause)
        if match is None:
            raise ValueError(f"unsupported condition: {clause}")
        name, operator, raw = match.groups()
        if name not in CONDITION_FIELDS:
            raise ValueError(f"unsupported field: {name}")
        value, bare = fields.get(name, F.lit(None).cast("string")), raw.strip("\"'")
        if name == "price":
            number = re.search(r"-?\d+(?:\.\d+)?", bare)
            left, right = money.first_number(value.cast("string")), F.lit(number[0] if number else None).cast("decimal(18,4)")
            test = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right, "!=": left != right}[operator]
        elif operator in ("==", "!="):
            left, right = text.equality_text(value), F.lit(" ".join(bare.lower().split()))
            test = left == right if operator == "==" else ~left.eqNullSafe(right)
        else:
            raise ValueError(f"{operator} does not order text")
        out = out & F.coalesce(test, F.lit(operator == "!="))
    return out


def rule_met(operator: str, value: Column, operand: str | None = None) -> Column:
    """Alert rule on one value."""
    number, other = money.first_number(value.cast("string")), F.lit(operand).cast("decimal(18,4)") if operand is not None and re.fullmatch(r"-?\d+(\.\d+)?", operand) else F.lit(None).cast("decimal(18,4)")
    plain = text.equality_text(value.cast("string"))
    tests = {
        "exists": ~text.is_empty(value.cast("string")), "missing": text.is_empty(value.cast("string")), "lt": number < other, "gt": number > other, "le": number <= other, "ge": number >= other,
        "equals": plain == F.lit((operand or "").lower().strip()), "not_equals": ~plain.eqNullSafe(F.lit((operand or "").lower().strip())),
    }
    return F.coalesce(tests[operator], F.lit(False))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Events between two snapshots with unique keys: record_new, record_removed, and field_changed for each tracked field
    whose normalised value differs. Values are as they stand, not normalised."""

    def normalised(name: str, c: Column) -> Column:
        plain = text.equality_text(c.cast("string"))
        return F.coalesce(money.first_number(c.cast("string")).cast("string"), plain) if "price" in name else plain

    old = before.select(F.col(key).alias("_old"), *(F.col(f).cast("string").alias(f"old_{f}") for f in fields))
    new = after.select(F.col(key).alias("_new"), *(F.col(f).cast("string").alias(f"new_{f}") for f in fields))
    both = old.join(new, F.col("_old") == F.col("_new"), "full")
    none = F.lit(None).cast("string")
    row = lambda kind, field=None, a=none, b=none: F.struct(F.lit(kind).alias("event_type"), F.lit(field).cast("string").alias("field_name"), a.alias("old_value"), b.alias("new_value"))
    changed = [F.when(~normalised(f, F.col(f"old_{f}")).eqNullSafe(normalised(f, F.col(f"new_{f}"))), row("field_changed", f, F.col(f"old_{f}"), F.col(f"new_{f}"))) for f in fields]
    events = F.when(F.col("_old").isNull(), F.array(row("record_new"))).when(F.col("_new").isNull(), F.array(row("record_removed"))).otherwise(F.array_compact(F.array(*changed)))
    return both.select(F.coalesce("_old", "_new").alias(key), F.explode(events).alias("e")).select(key, "e.*")


def due(jobs: DataFrame, now: Column, priorities: dict[str, int]) -> DataFrame:
    """Jobs whose next run has come, by priority, time and id."""
    rank = F.lit(len(priorities))
    for name, place in priorities.items():
        rank = F.when(F.col("priority") == name, place).otherwise(rank)
    return jobs.where(F.col("next_run_at") <= now).withColumn("rank", rank).orderBy("rank", "next_run_at", "id")


def streaks(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds `streak`: rows in a row, up to this one, with the same value as the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    grouped = df.withColumn("_run", F.sum(changed).over(w))
    return grouped.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)) - 1).drop("_run")


def retained(df: DataFrame, time: str, days: int) -> DataFrame:
    """Rows no older than days (one at least) before the newest."""
    newest = df.select(F.max(time).alias("_newest"))  # one row
    return df.join(F.broadcast(newest), F.col(time) >= F.col("_newest") - F.make_dt_interval(F.lit(max(1, days)))).drop("_newest")
