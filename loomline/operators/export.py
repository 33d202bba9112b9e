"""Exports: header of open records, flat tables, cleaned records, and the identity upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(data: Column) -> Column:
    """A map without empty values and without private keys (`_` first)."""
    return F.map_filter(data, lambda k, v: v.isNotNull() & (v != "") & ~k.startswith("_"))


def header(df: DataFrame, data: str = "data") -> list[str]:
    """Sorted union of the keys of all rows: as many names as columns, so they fit the driver."""
    return sorted(r["k"] for r in df.select(F.explode(F.map_keys(cleaned(F.col(data)))).alias("k")).distinct().collect())


def _keyed(name: str):
    return lambda e: e["key"] == F.lit(name)


def flat(df: DataFrame, keep: list[str], data: str = "data") -> DataFrame:
    """keep, and a column for each key of the header; missing values are blank."""
    return df.select(*keep, *(F.coalesce(F.get(F.filter(F.map_entries(cleaned(F.col(data))), _keyed(k)), F.lit(0))["value"], F.lit("")).alias(k) for k in header(df, data)))


def upserted(stored: DataFrame, incoming: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """incoming with `action`: insert, update or none, by key and fingerprint. Rows without a key are dropped; of rows with
    one key the last fingerprint in order stays."""
    unique = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(fingerprint, *[c for c in incoming.columns if c not in (key, fingerprint)])).alias("r")).select(key, "r.*")
    old = stored.select(F.col(key).alias("_key"), F.col(fingerprint).alias("_old"))
    action = F.when(F.col("_key").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col(fingerprint)), "none").otherwise("update")
    return unique.join(old, F.col(key) == F.col("_key"), "left").withColumn("action", action).drop("_key", "_old")


def deliveries(events: DataFrame, url: Column, most_bytes: int = 10_000) -> DataFrame:
    """One row a changed field whose condition is met: skipped without a URL, failed if the payload is too large, else
    pending."""
    payload = F.to_json(F.struct(*events.columns))
    state = F.when(F.coalesce(url, F.lit("")) == "", "skipped").when(F.octet_length(payload) > most_bytes, "failed").otherwise("pending")
    return events.where((F.col("event_type") == "field_changed") & F.col("condition_met")).select("*", payload.alias("payload"), state.alias("status"))
