"""Fill rates, confidence, weighted audits, and the quality of fields and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Our own defaults: weights of fields in a record's confidence, and of the tiers of their sources.
FIELD_WEIGHTS = {"title": 3.0, "brand": 1.5, "price": 2.0, "category": 1.0, "size": 0.5}
TIERS = {"authoritative": 1.0, "structured": 0.9, "dom": 0.75, "llm": 0.65, "text": 0.58}
# Audit dimensions' weights, and the cap where the first fails outright.
AUDIT_WEIGHTS = {"D-AID1": 0.20, "D-AID2": 0.25, "D-AID3": 0.20, "D-AID4": 0.15, "D-AID5": 0.10, "D-AID6": 0.10}
AUDIT_CAP = 30


def fill_rates(df: DataFrame, fields: list[str], gate: float = 0.8) -> DataFrame:
    """field, rate and whether it passes, in one pass over df."""
    rates = df.agg(*(F.avg(F.when(~text.is_empty(F.col(f).cast("string")), 1.0).otherwise(0.0)).alias(f) for f in fields))
    return rates.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.bround(F.col(f), 4).alias("rate")) for f in fields))).alias("r")).select("r.field", "r.rate", (F.col("r.rate") >= gate).alias("passes"))


def confidence(values: dict[str, Column], penalties: dict[str, Column], tier: str = "structured") -> Column:
    """Sum of weight * quality * (1 - penalty) over sum of weights, four decimals; empty fields score nothing."""
    total = sum(FIELD_WEIGHTS[f] for f in values)
    score = F.lit(0.0)
    for f, c in values.items():
        kept = 1 - F.least(penalties.get(f, F.lit(0.0)), F.lit(0.85))
        score = score + F.when(~text.is_empty(c.cast("string")), FIELD_WEIGHTS[f] * TIERS[tier] * kept).otherwise(0.0)
    return F.bround(score / total, 4)


def audit_score(scores: dict[str, Column]) -> Column:
    """Weighted sum, truncated; at most AUDIT_CAP where the first dimension is 0."""
    weighted = F.lit(0.0)
    for name, c in scores.items():
        weighted = weighted + c * AUDIT_WEIGHTS[name]
    whole = F.floor(F.round(weighted, 6)).cast("int")
    return F.when(scores["D-AID1"] == 0, F.least(whole, F.lit(AUDIT_CAP))).otherwise(whole)
